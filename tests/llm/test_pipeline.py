"""The pipeline's stages against plain versions over a small table."""

import random

import duckdb
import pytest

from tests.llm import plain
from tests.llm.test_operators import VOCABULARY, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    item = " ".join(rng.choice(VOCABULARY) + "x" for _ in range(25))
    german = lambda n: " ".join(rng.choice(["und", "nicht", "schön", "über", "werden", "straße"]) for _ in range(n))
    rows = []
    for i in range(70):
        text = "\n".join(prose(rng, rng.randrange(4, 30)) for _ in range(3)) if i % 3 else german(rng.randrange(5, 60))
        if i % 4 == 0:
            text += "\nThis page is provided by the archive of the town"
        rows.append((text, "de" if i % 3 == 0 else "la"))
    rows += [(rows[1][0] + " more", "la"), (rows[2][0], "la"), (rows[2][0], "la"), (item, "la"), (prose(rng, 400) + " " + item, "la"), (None, "la"), ("", None), ("12 34 --", "la")]
    rows = [(i, t, x, f"s{i % 3}", len(t or ""), "kept") for i, (t, x) in enumerate(rows)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, further string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    import corpus_pipeline as C

    from nighspark.llm import oracles

    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"] and C.ORACLE_SQL is None
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for name, stage in C.STAGES:
        out = stage(spark, steps[-1], folder)
        if name != "packing":
            assert out.columns == docs.columns
        path = f"{folder}/out-{name}"
        out.write.parquet(path)
        steps.append(spark.read.parquet(path))
    texts = [{r["doc_id"]: r["text"] for r in s.collect()} for s in steps[:5]]
    assert texts[1] == {i: t for i, t in texts[0].items() if t and any(c.isalpha() for c in t)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in texts[1].items()])
    assert texts[2] == {r[0]: r[3] for r in con.execute(oracles.OP7).fetchall()}
    assert texts[2] != texts[1]
    assert texts[3] == {i: texts[2][i] for i, (_, low) in plain.near(texts[2], 5).items() if i == low}
    assert len(texts[3]) < len(texts[2])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {i: t for i, t in texts[3].items() if not (lambda n, hit, _: hit > 0 and 20 * hit >= n)(*plain.contamination(t, items))}
    assert texts[4] == clean and 0 < len(texts[3]) - len(clean) <= 2
    rows = steps[5].collect()
    assert {r["doc_id"] for r in rows} == set(clean)
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 1024 and len(fill) <= 1.2 * sum(fill.values()) / 1024 + 2
    again = C.run(spark, folder)
    assert again.count() == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2].collect())


def test_stages_take_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, folder)
        assert out.count() == 0


def test_registered_queries_exist():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
