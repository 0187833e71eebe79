import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from sievelake.llm.neardup import THRESHOLD
from test_neardup import jaccard, shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and ing tion er", "de": "der und sch keit ung ge", "fr": "le eaux ment que oi é", "es": "los ción ñó ez ar que"}


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng, root = random.Random(8), tmp_path_factory.mktemp("sf")
    line = lambda lang: " ".join("".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 20))).capitalize() + "."
    shared, rows, labels = line("en"), [], []
    for d in range(160):
        lang = rng.choice(["en", "en", "en", "de", "fr", "es"])
        lines = [line(lang) for _ in range(rng.randint(2, 6))]
        if d % 9 == 0:
            lines.insert(1, shared)
        text, good = "\n".join(lines), d % 6 != 5
        if not good:
            text = " ".join(w + "###" for w in text.split())
        if d % 10 == 3 and d > 30:
            w = rows[d - 30][1].split(" ")
            w[3] = "changed"
            w[-2] = "also"
            text, lang = " ".join(w), rows[d - 30][2]
        rows.append((d, text, lang, "s", len(text)))
        labels.append((d, int("###" not in text), 0))
    rows += [(400, rows[0][1], rows[0][2], "s", 1), (None, None, None, None, None), (401, "", "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), rows


def test_stages_one_by_one(spark, data, tmp_path):
    root, rows = data
    docs, seen = spark.read.parquet(f"{root}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, root)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    before, quality = {d: t for d, t, *_ in rows}, seen["quality"]
    clean = {d for d, t, *_ in rows if t and "###" not in t}
    assert len(clean & {r.doc_id for r in quality}) >= 0.97 * len(clean) and sum("###" in r.text for r in quality) <= 2
    assert all(r.text == before[r.doc_id] for r in quality)
    lines = Counter(x.strip() for r in seen["line_dedup"] for x in r.text.split("\n") if x.strip())
    assert max(lines.values()) == 1 and set(lines) <= {x.strip() for r in quality for x in r.text.split("\n")}
    firsts = defaultdict(list)
    for r in sorted(quality, key=lambda r: r.doc_id):
        for x in r.text.split("\n"):
            firsts[x.strip()].append(r.doc_id)
    kept = {(x.strip(), r.doc_id) for r in seen["line_dedup"] for x in r.text.split("\n") if x.strip()}
    assert all(firsts[x][0] == d for x, d in kept)
    sets = {r.doc_id: shingle_set(r.text) for r in seen["line_dedup"]}
    stay = {r.doc_id for r in seen["near_dedup"]}
    close = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= THRESHOLD]
    assert sum(a in stay and b in stay for a, b in close) <= 0.1 * len(close)
    assert sets.keys() - stay <= {b for _, b in close}
    mixed = Counter(r.doc_id for r in seen["mixing"])
    assert mixed.keys() == stay and min(mixed.values()) >= 1
    packed = Counter()
    for r in seen["packing"]:
        packed[r.doc_id] += r.length
    assert packed == Counter({r.doc_id: 0 for r in ()}) + sum((Counter({r.doc_id: len(r.text.split())}) for r in seen["mixing"]), Counter())


def test_run_equals_its_stages(spark, data):
    root, _ = data
    out = corpus_pipeline.run(spark, root)
    assert out.columns == ["doc_id", "start", "length", "sequence", "offset"] and out.count() > 0
    assert [type(n) for n, _ in corpus_pipeline.STAGES] == [str] * 5 and corpus_pipeline.ORACLE_SQL is None


def test_defined_cases(spark, data, tmp_path):
    root, rows = data
    extra = ["map('a', text) as stats", "1 as __id", "2 as `KEEP`", "3 as node"]
    long = (500, " ".join(f"the w{i} of" for i in range(60_000)), "en", "s", 1)
    docs = spark.createDataFrame([*rows, long, long, rows[1]], SCHEMA).selectExpr("*", *extra)
    for given in (docs, docs.where("false"), docs.where("text is null or text = ''"), docs.where("doc_id = 500")):
        out = given
        for name, stage in corpus_pipeline.STAGES:
            whole, out = out, stage(spark, out, root)
            if stage is not corpus_pipeline.pack_sequences:
                assert out.schema.names == docs.schema.names
                path = str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}")
                out.write.parquet(path)
                out = spark.read.parquet(path)
        packed = {r.doc_id for r in out.collect()}
        assert packed == {r.doc_id for r in whole.select("doc_id", "text").collect() if (r.text or "").split()}


def test_null_and_empty_texts_of_single_stages(spark, data):
    root, _ = data
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, " \n ", "en", "s", 3)], SCHEMA)
    left = {name: stage(spark, docs, root).count() for name, stage in corpus_pipeline.STAGES}
    assert left == {"quality": 0, "line_dedup": 3, "near_dedup": 3, "mixing": 3, "packing": 0}


def test_tables_between_stages_are_deleted(spark, data):
    from sievelake import storage

    corpus_pipeline.run(spark, data[0]).collect()
    assert sum("pipeline-" in path for path in storage._open) <= 2  # what packing reads, of this run and the one above
