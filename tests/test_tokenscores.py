"""Windows, stitched scores and the join of tokens with sentences against plain loops over the text."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from papertide.functions.manuscript import SENTENCE_END
from papertide.operators import tokenscores

LENGTH = lambda window: F.zip_with("starts", "ends", lambda a, b: (b - a).cast("double"))


def texts() -> list[tuple[int, str | None]]:
    rng = random.Random(6)
    say = lambda n: "".join(rng.choice(["a", "word", "étude", "中文", "longerword", "(x)", "12"]) + rng.choice([" ", "  ", ". ", '." ', "?\n", "\n\n", " \n \n", "\t", ".", "…"]) for _ in range(n))
    return [(1, say(40)), (2, say(400)), (3, ""), (4, None), (5, " \n "), (6, "one"), (7, "  lead and tail. "), (8, "x" * 5000 + " end of it all, after a very long word that fills bins."), (9, say(7)), (10, "a. b. c.")]


def plain(text: str, threshold: float, share: float, cap: int):
    found = [(m.start(), m.end(), float(m.end() - m.start())) for m in tokenscores.WORD.finditer(text)]
    kept = found[:cap]
    if not kept:
        return None
    best = sorted((s for *_, s in kept), reverse=True)[: max(1, -(-len(kept) * share // 1).__int__())]
    cuts = sorted({0, len(text), *(m.end() for m in re.finditer(SENTENCE_END, text))})
    judged = flagged = 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        inside = [s for x, y, s in kept if a <= (x + y) / 2 < b]
        if len(inside) >= 8:
            judged += 1
            flagged += sum(inside) / len(inside) > threshold
    return len(kept), len(found) > cap, sum(best) / len(best), judged, flagged


@pytest.mark.parametrize(("size", "cap"), [(2046, 16384), (7, 100), (10, 40), (1, 3)])
def test_windows_give_what_one_pass_over_the_whole_gives(spark, size, cap):
    frame = spark.createDataFrame(texts(), "doc_id int, text string").repartition(3)
    got = {r.doc_id: (r.tokens, r.truncated, pytest.approx(r.score), r.sentences, r.flagged) for r in tokenscores.text_figures(frame, LENGTH, 4.0, size=size, cap=cap).collect()}
    want = {i: p for i, t in texts() if t is not None and (p := plain(t, 4.0, 0.25, cap))}
    assert want == got
    window = tokenscores.windows(frame, size=size, cap=cap).collect()
    assert all(1 <= len(w.starts) == len(w.ends) <= size for w in window)


def test_windows_hold_one_window_at_a_time():
    """The table function yields a window before it reads on."""
    stream = tokenscores.Windows().eval("a b c d e f g", 2, 6)
    assert [next(stream)[:3] for _ in range(2)] == [(0, [0, 2], [1, 3]), (2, [4, 6], [5, 7])]
    assert list(stream) == [(4, [8, 10], [9, 11], True)]
    assert list(tokenscores.Windows().eval("a b", 2, 2)) == [(0, [0, 2], [1, 3], False)] and not list(tokenscores.Windows().eval(None, 2, 2))


@pytest.mark.parametrize("size", [1, 3, 1024])
def test_each_token_meets_the_sentence_of_its_middle_once(spark, size):
    rng = random.Random(1)
    cuts = sorted(rng.sample(range(1, 200), 12))
    sentence = [(1, k, a, b) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 200], strict=True))] + [(2, 0, 0, 50)]
    token = [(d, a, a + rng.randint(0, 9)) for d in (1, 2, 3) for a in rng.sample(range(195), 60)]
    met = tokenscores.within(spark.createDataFrame(token, "doc_id int, start int, end int"), spark.createDataFrame(sentence, "doc_id int, sentence int, start int, end int"), size).collect()
    want = sorted((d, a, b, k) for d, a, b in token if b > a for e, k, x, y in sentence if e == d and x <= (a + b) / 2 < y)
    assert sorted((r.doc_id, r.start, r.end, r.sentence) for r in met) == want
