import random

from pyspark.sql import functions as F

from larkspur.llm import pii


def every(ws, wanted):
    """Hits by comparing all contexts of all words."""
    out = set()
    for i in range(len(ws)):
        for n in range(1, pii.WORDS + 1):
            if i >= n and f"left {' '.join(ws[i - n : i])}" in wanted:
                out.add((i, f"left {' '.join(ws[i - n : i])}"))
            if i + n < len(ws) and f"right {' '.join(ws[i + 1 : i + 1 + n])}" in wanted:
                out.add((i, f"right {' '.join(ws[i + 1 : i + 1 + n])}"))
    return out


def test_search_of_contexts_finds_all_and_looks_up_few(spark):
    wanted = ["left the", "left by the", "left sent by the", "left from", "right and then", "right said", "left of my own"]
    table = pii._table(spark.createDataFrame([(p,) for p in wanted], "pattern string"), F.lit(2))
    r = random.Random(3)
    ws = [r.choice(["the", "by", "sent", "from", "and", "then", "said", "own", "my", "of", *(f"w{i}" for i in range(40))]) for _ in range(20_000)]
    looked_up = []

    class Counted(pii.Contexts):
        def __call__(self, pattern):
            looked_up.append(pattern)
            return super().__call__(pattern)

    contexts = Counted(table, 1)
    got = contexts.hits(ws)
    assert len(got) == len(set(got)) and set(got) == every(ws, set(wanted))
    # once for each word, its sides and its use as a second word, and for few pairs: never for each place in a text
    assert len(looked_up) < 1_500
    contexts.drop("left the")
    assert set(contexts.hits(ws)) == {x for x in every(ws, set(wanted)) if x[1] != "left the"}
