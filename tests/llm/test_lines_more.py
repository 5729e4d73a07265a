import random

from pyspark.sql import functions as F

from rolefit.llm.line_dedup import banded_distance, counts_allow, letter_counts, line_blocks, line_distance, without_repeated_lines


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def edited(r, text, n, letters):
    out = list(text)
    for _ in range(n):
        p = r.randrange(len(out) + 1)
        what = r.randrange(3)
        if what == 0 or p == len(out):
            out.insert(p, r.choice(letters))
        elif what == 1:
            del out[p]
        else:
            out[p] = r.choice(letters)
    return "".join(out)


def test_banded_distance_equals_the_full_table(spark):
    r = random.Random(7)
    rows = []
    for k in range(1500):
        a = "".join(r.choice("abé🎉 ") for _ in range(r.randint(0, 25) if k % 3 else r.randint(60, 110)))
        b = edited(r, a, r.randint(0, 5), "abcé")
        rows.append((a, b, distance(a, b)))
    frame = spark.createDataFrame(rows, "a_line string, b_line string, d int")
    for s in "ab":
        line = F.col(f"{s}_line")
        frame = frame.withColumn(f"{s}_n", F.char_length(line)).withColumns({f"{s}_{c}": v for c, v in zip(("head", "tail"), line_blocks(line, F.char_length(line)), strict=True)})
        frame = frame.select("*", *(c.alias(f"{s}_{k}") for k, c in enumerate(letter_counts(line))))
    for k in (1, 2, 3):
        got = frame.where(F.abs(F.col("a_n") - F.col("b_n")) <= k).select("d", banded_distance(F.col("a_line"), F.col("b_line"), k).alias("x"), line_distance("a", "b", k).alias("y"), counts_allow(k).alias("allowed")).collect()
        assert len(got) > 500
        for g in got:
            assert (g.x, g.y) == (g.d, g.d) if g.d <= k else g.x > k and g.y > k
            assert g.allowed or g.d > k


def test_repeated_ids_keep_their_own_lines(spark):
    copy = "the very same line of more than twenty characters"
    rows = [(1, copy), (5, "a line that is nowhere else in this table"), (5, copy), (7, f"x\n{copy}\ny"), (7, f"x\n{copy}\ny"), (None, copy), (8, None)]
    got = sorted(((x.doc_id, x.text) for x in without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), short_copies=True).collect()), key=str)
    assert got == sorted([(1, copy), (5, "a line that is nowhere else in this table"), (7, "x\ny"), (7, "x\ny"), (None, copy), (8, None)], key=str)
