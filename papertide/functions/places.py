"""Institutions named in affiliations: ordered rules, the national universities above their members, and whether an affiliation is a person's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.functions import text
from papertide.functions.runtime import kept

#: Pattern on the folded text (any case), full name, short name, whether it is a university; in order, specific ones first.
RULES = [
    (r"vin ?uni", "VinUniversity", "VinUni", True),
    (r"vin ?ai\b", "VinAI Research", "VinAI", False),
    (r"vin ?big ?data|vingroup big data", "VinBigData", "VinBigData", False),
    (r"cinnamon ?(ai|lab)", "Cinnamon AI", "Cinnamon AI", False),
    (r"nvidia.*(viet ?nam|ho chi minh|ha ?noi)", "NVIDIA Vietnam", "NVIDIA", False),
    (r"vinbrain|vinfast|vingroup|vin ?robotics|vinmotion|vintech", "Vingroup", "Vingroup", False),
    (r"ha ?noi university of science (and |& )?tech|\bsoict\b|bach khoa ha ?noi", "Hanoi University of Science and Technology", "HUST", True),
    (r"university of science and technology of ha ?noi|\busth\b", "University of Science and Technology of Hanoi", "USTH", True),
    (r"ha ?noi university of industry|\bhaui\b|dai hoc cong nghiep ha ?noi", "Hanoi University of Industry", "HaUI", True),
    (r"ha ?noi university of science\b(?! (and |& )?tech)|vnu university of science|vnu\W+hus\b", "VNU University of Science, Hanoi", "VNU-HUS", True),
    (r"ho chi minh (city )?university of technology and education|university of technical education\W+ho chi minh", "Ho Chi Minh City University of Technology and Education", "HCMUTE", True),
    (r"\bhcmut\b|ho chi minh (city )?university of technology(?! and education)|bach khoa", "Ho Chi Minh City University of Technology, VNU-HCM", "HCMUT", True),
    (r"\bhcmus\b|university of science\W+(vnu|vietnam national|ho chi minh|hcm)|ho chi minh (city )?university of science\b|(vnu\W?hcm|vnuhcm)\W+university of science", "University of Science, VNU-HCM", "HCMUS", True),
    (r"university of information technology\W+(vnu|vietnam|ho chi minh|hcm)|\buit\b\W+(vnu|ho chi minh|hcm)", "University of Information Technology, VNU-HCM", "UIT", True),
    (r"international university\W+(vnu|vietnam national|ho chi minh|hcm)", "International University, VNU-HCM", "HCMIU", True),
    (r"university of engineering and technology\W+(vnu|vietnam|ha ?noi)|vnu\W+(university of engineering|uet)|viet ?nam national university\W+university of engineering", "VNU University of Engineering and Technology", "VNU-UET", True),
    (r"fpt university", "FPT University", "FPT University", True),
    (r"\bfpt\b", "FPT Software AI Center", "FPT", False),
    (r"posts (and|&) telecom(munications?|\.)? inst(itute|\.)? (of )?tech|\bptit\b", "Posts and Telecommunications Institute of Technology", "PTIT", True),
    (r"phenikaa", "Phenikaa University", "Phenikaa", True),
    (r"ton duc thang", "Ton Duc Thang University", "TDTU", True),
    (r"duy tan univ", "Duy Tan University", "Duy Tan", True),
    (r"ho chi minh (city )?university of economics|university of economics\W+ho chi minh|\bueh\b", "University of Economics Ho Chi Minh City", "UEH", True),
    (r"ho chi minh (city )?university of education", "Ho Chi Minh City University of Education", "HCMUE", True),
    (r"ha ?noi national university of education", "Hanoi National University of Education", "HNUE", True),
    (r"national economics university", "National Economics University", "NEU", True),
    (r"ha ?noi medical university", "Hanoi Medical University", "HMU", True),
    (r"le quy don", "Le Quy Don Technical University", "LQDTU", True),
    (r"thuy ?loi univ", "Thuyloi University", "TLU", True),
    (r"thang ?long univ", "Thang Long University", "DHTL", True),
    (r"can tho university(?! of)", "Can Tho University", "CTU", True),
    (r"hue university", "Hue University", "Hue University", True),
    (r"eastern international univ", "Eastern International University", "EIU", True),
    (r"university of da ?nang|da ?nang university", "University of Danang", "UDN", True),
    (r"rmit\b.*viet ?nam", "RMIT University Vietnam", "RMIT Vietnam", True),
    (r"fulbright university viet ?nam", "Fulbright University Vietnam", "Fulbright VN", True),
    (r"vietnam\w* german university|vietnamese-german", "Vietnamese-German University", "VGU", True),
    (r"viettel", "Viettel", "Viettel", False),
    (r"\bvietai\b", "VietAI", "VietAI", False),
    (r"viet ?nam academy of science and technology", "Vietnam Academy of Science and Technology", "VAST", True),
    (r"viet ?nam national university\W+(ho chi minh|hcm)|\bvnu\W?hcm\b|\bvnuhcm\b", "Vietnam National University, Ho Chi Minh City", "VNU-HCM", True),
    (r"viet ?nam national university|\bvnu\b", "Vietnam National University, Hanoi", "VNU", True),
]
#: Place names that make an affiliation one of the country though no rule knows it.
GENERIC = r"viet ?nam\b|\bha ?noi\b|ho chi minh|\bsaigon\b|\bda ?nang\b|\bcan tho\b|\bthai nguyen\b|\bquy nhon\b|\bnha trang\b|\bhai ?phong\b|\bthu dau mot\b"
#: The national university above each member school. "VNU" alone is the one in Hanoi only where none of the other is named.
PARENT = {"VNU-UET": "VNU", "VNU-HUS": "VNU", "HCMUS": "VNU-HCM", "HCMUT": "VNU-HCM", "UIT": "VNU-HCM", "HCMIU": "VNU-HCM"}
#: The members of the southern university, which its northern namesake must not be taken for.
SOUTH = ("HCMUS", "HCMUT", "UIT", "HCMIU", "VNU-HCM")


def parent(short: Column) -> Column:
    """The short name of the university above, else null."""
    return F.create_map(*[F.lit(x) for pair in PARENT.items() for x in pair])[short]


def _entry(full: Column, short: Column, university: Column) -> Column:
    return F.struct(full.alias("full"), short.alias("short"), university.alias("university"))


def _hits(low: Column) -> Column:
    """The rules that hold for a folded affiliation in lower case, which patterns without regard to case would search more slowly."""
    return F.array_compact(F.array(*(F.when(low.rlike(p), _entry(F.lit(full), F.lit(short), F.lit(uni))) for p, full, short, uni in RULES)))


def _settled(hits: Column, said: Column) -> Column:
    generic = F.when((F.size(hits) == 0) & said.rlike("(?i)" + GENERIC), F.array(_entry(said, said, F.lit(True))))
    return F.coalesce(generic, F.when(F.exists(hits, lambda x: x["short"].isin(*SOUTH)), F.filter(hits, lambda x: x["short"] != "VNU")), hits)


def institutions(affiliation: Column) -> Column:
    """All institutions that an affiliation names, as an array of (full, short, university) in the order of the rules; a null or blank one names none."""
    said = F.trim(text.folded(affiliation))
    return _settled(_hits(F.lower(said)), said)


def known_institutions(rows: DataFrame, affiliation: str = "aff", into: str = "places") -> DataFrame:
    """Each different affiliation with the institutions that it names, and in `said` its normalised text."""
    # One step after the other, so that each is evaluated once.
    plain = rows.where(F.col(affiliation).isNotNull()).select(affiliation).distinct().withColumn("flat", F.trim(text.folded(F.col(affiliation))))
    known = plain.withColumn("low", F.lower("flat")).withColumn("hits", _hits(F.col("low")))
    return kept(known.select(affiliation, _settled(F.col("hits"), F.col("flat")).alias(into), text.norm_name(F.col("flat"), True).alias("said")))


def with_institutions(rows: DataFrame, affiliation: str = "aff", into: str = "places") -> DataFrame:
    """The rows with the institutions of their affiliation, and in `said` its normalised text, both found once for each different affiliation. Rows without one have an empty
    array and a null text."""
    # Both are kept: the rows are read twice, and from what an affiliation names the optimizer would else infer filters that apply all rules to each row again.
    rows = kept(rows)
    known = known_institutions(rows, affiliation, into)
    empty = F.array().cast("array<struct<full:string,short:string,university:boolean>>")
    return rows.join(known, affiliation, "left").withColumn(into, F.coalesce(into, empty))


def with_names(rows: DataFrame, institution: str = "institution", into: str = "named") -> DataFrame:
    """The rows with the normalised name of their institution, found once for each different one."""
    return rows.join(rows.select(institution).distinct().withColumn(into, text.norm_name(F.col(institution))), institution)


def same_institution(found: Column, said: Column, institution: Column, named: Column, short: Column) -> Column:
    """Whether an affiliation, of which with_institutions() gives what it names and its text, names this institution (with_names()), the university above it, or holds its name."""
    above = parent(short)
    by_rule = F.exists(found, lambda x: (x["short"] == short) | F.coalesce(x["short"] == above, F.lit(False)) | (x["full"] == institution))
    return by_rule | F.coalesce((named != "") & F.contains(said, named), F.lit(False))


def at_institution(found: Column, affiliation: Column, said: Column, institution: Column, named: Column, short: Column) -> Column:
    """Whether a paper counts as written at a person's institution: their own entry is missing, names it, has its short name as a word, or names just
    the "University of Science" for its two schools."""
    word = F.rlike(affiliation, F.concat(F.lit(r"(?<![\w-])\Q"), short, F.lit(r"\E(?![\w-])")))
    school = short.isin("HCMUS", "VNU-HUS") & affiliation.rlike(r"(?i)\buniversity of science\b")
    rules = [F.coalesce(F.trim(affiliation), F.lit("")) == "", same_institution(found, said, institution, named, short), (F.length(short) >= 3) & word, school]
    return reduce(lambda a, b: a | b, (F.coalesce(r, F.lit(False)) for r in rules))


#: Mail domains, which a title page often prints where it shortens the affiliation.
DOMAINS = {
    "HUST": ["hust.edu.vn"], "VinUni": ["vinuni.edu.vn"], "PTIT": ["ptit.edu.vn"], "HCMUS": ["hcmus.edu.vn"], "VNU-UET": ["vnu.edu.vn"], "RMIT": ["rmit.edu.vn"], "UEH": ["ueh.edu.vn"],
    "VAST": ["math.ac.vn", "vast.vn"], "HCMIU": ["hcmiu.edu.vn"], "NEU": ["neu.edu.vn"], "Phenikaa": ["phenikaa-uni.edu.vn"], "CTU": ["ctu.edu.vn"], "UIT": ["uit.edu.vn"], "FPTU": ["fpt.edu.vn"],
    "UDN": ["udn.vn"], "HCMUT": ["hcmut.edu.vn"], "HaUI": ["haui.edu.vn"],
}


def with_page_facts(pages: DataFrame, page: str = "page") -> DataFrame:
    """Pages with what printed() asks of them, found once for each page: the folded text in `flat`, and the short names of the institutions in it in `shorts`."""
    # Reading a page takes far longer than its bytes tell, so small pages are not drawn together into few tasks.
    spread = pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(c for c in pages.columns if c != page))
    flat = spread.withColumn("flat", F.trim(F.regexp_replace(text.folded(F.col(page)), r"\s+", " "))).drop(page).withColumn("low", F.lower("flat"))
    return flat.withColumn("hits", _hits(F.col("low"))).withColumn("shorts", F.transform(_settled(F.col("hits"), F.col("flat")), lambda x: x["short"])).drop("hits", "low")


def printed(flat: Column, shorts: Column, institution: Column, short: Column) -> Column:
    """Whether a title page names an institution: by rule, full name, short name as a word, the two schools' common name, or a mail domain."""
    low = F.lower(flat)
    mail = F.create_map(*[F.lit(c) for k, v in DOMAINS.items() for c in (k, "|".join(v).replace(".", r"\."))])[short]
    rules = [
        F.array_contains(shorts, short),
        F.contains(low, F.lower(institution)),
        F.rlike(flat, F.concat(F.lit(r"(?<![\w-])\Q"), short, F.lit(r"\E(?![\w-])"))),
        short.isin("HCMUS", "VNU-HUS") & low.rlike(r"\buniversity of science\b"),
        F.rlike(low, mail),
    ]
    return reduce(lambda a, b: a | b, (F.coalesce(r, F.lit(False)) for r in rules))
