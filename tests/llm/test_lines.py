import random

import pytest

from sievelake.llm.lines import dedup_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\r\f\v"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(rows, order, edits, chars):
    lines = {}  # stripped line -> place of its first occurrence
    for place in order:
        for no, line in enumerate(x for x in (s.strip(SPACES) for s in (rows[place][1] or "").split("\n")) if x):
            lines.setdefault(line, (order.index(place), no))
    bound = lambda a, b: min(edits, min(len(a), len(b)) // chars)
    gone = {a for a in lines for b in lines if lines[b] < lines[a] and abs(len(a) - len(b)) <= bound(a, b) > 0 and distance(a, b) <= bound(a, b)}
    out = []
    for at, place in enumerate(order):
        no, kept, some = -1, [], False
        for line in (rows[place][1] or "").split("\n"):
            s = line.strip(SPACES)
            no += bool(s)
            if not s or (lines[s] == (at, no) and s not in gone):
                kept.append(line)
                some |= bool(s)
        if some or not (rows[place][1] or "").strip(SPACES + "\n"):
            out.append((rows[place][0], "\n".join(kept) if rows[place][1] is not None else None))
    return out


def edited(rng, line):
    i, c = rng.randrange(len(line)), rng.choice("abcé漢")
    return rng.choice([line[:i] + line[i + 1 :], line[:i] + c + line[i:], line[:i] + c + line[i + 1 :]])


@pytest.mark.parametrize("edits,chars", [(0, 12), (1, 12), (1, 1), (2, 12), (2, 3), (3, 5)])
def test_against_brute_force(spark, edits, chars):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé 漢") for _ in range(rng.choice([3, 11, 12, 13, 23, 24, 25, 26, 40]))).strip(SPACES) or "x" for _ in range(50)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 7)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                line = edited(rng, line) if line else "x"
            lines.append(rng.choice([line, line, line, "", "  ", " " + line + "\t"]))
        rows.append((d, "\n".join(lines), "en", "s", sum(map(len, lines))))
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(5), max_edits=edits, chars_per_edit=chars).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(brute(rows, list(range(len(rows))), edits, chars))
    assert all(r.n_chars == len(r.text) for r in got if r.text != rows[r.doc_id][1])


def test_defined_cases(spark):
    long = "word " * 30000
    rows = [(None, "a shared line that is long enough", "en", "s", 1), (4, None, None, None, None), (5, "", "en", None, 0), (6, " \n ", "en", "s", 3),
            (2, "a shared line that is long enough\nown", "en", "s", 9), (9, "own too\r\nq", "en", "s", 9), (9, "own too\r\nq", "en", "s", 9), (11, long, "en", "s", 1), (12, long + "x", "de", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as ID_", "2 as `__kept`", "3 as `__TH`")
    got = dedup_lines(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(
        [(4, None), (5, ""), (6, " \n "), (2, rows[4][1]), (9, "own too\r\nq"), (9, "own too\r\nq"), (11, long), (12, long + "x")], key=str
    )  # "word word" and "word wordx" differ by two edits at their trimmed ends
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
