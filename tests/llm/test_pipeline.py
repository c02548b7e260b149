"""The pipeline's stages, one after the other, and its effect on planted documents."""

import random

import corpus_pipeline

from .test_operators import SCHEMA, prose


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        text = prose(rng, rng.randint(30, 90))
        if i % 5 == 0:
            text += " vilexx nastyyy vilexx"
        rows.append((i, text, "en", f"s{i % 3}", len(text), "x", "y", 1, "z"))
        labels.append((i, 1, int(i % 5 == 0)))
    copies = [(300 + i, rows[1][1], *rows[1][2:]) for i in range(40)]
    (tmp_path / "t").mkdir()
    spark.createDataFrame(rows + copies, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/t/documents.parquet")
    spark.createDataFrame(labels[:250], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/t/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/t/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"{tmp_path}/t")
        out.write.parquet(f"{tmp_path}/{name}")
        if name != "encoding":
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids[name] = [r["doc_id"] for r in docs.collect()]
    clean = {i for i in range(300) if i % 5}
    assert not {i for i in ids["toxicity"] if i < 300 and i % 5 == 0} and clean <= set(ids["toxicity"])
    assert set(ids["near_copies"]) == clean and len(ids["near_copies"]) == len(clean)
    assert set(ids["mixing"]) <= clean and sorted(ids["encoding"]) == sorted(ids["mixing"])
    assert corpus_pipeline.run(spark, f"{tmp_path}/t").count() == len(ids["encoding"])


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null, empty, very long and repeated texts, null ids and sources, without labels; and an empty table."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rng = random.Random(2)
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \n", "en", "a", 2), (4, "one", "en", None, 3), (None, prose(rng, 20), "en", "b", None), (6, "y" * 200_000, "en", "b", 200_000), (7, prose(rng, 30_000), "en", "b", 0)]
    same = prose(rng, 50)
    rows += [(8, same, "en", "a", 1), (8, same, "en", "a", 1), (9, same, "de", "c", 1), (10, "漢字 😀 é", "zh", "c", 7)]
    for name, some in (("odd", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        if not some:
            assert out == []
            continue
        ids = [r["doc_id"] for r in out]
        assert 9 not in ids and not {1, 2, 3} & set(ids) and {r["doc_id"] for r in out} <= {4, None, 6, 7, 8, 10}
        assert all(r["ids_sha256"] and r["decoded_sha256"] and r["n_tokens"] > 0 for r in out)


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Columns named like helpers of the stages, in their own types, or with dots and blanks, come through unchanged."""
    rng = random.Random(3)
    helpers = ["_row", "_shard", "_words", "_size", "_start", "_order", "_all", "_drop_id", "_drop_hash", "_text_hash", "_listed", "_nth", "id", "node", "group", "epoch", "shard", "size", "row", "c0", "a.b", "with blank", "tick`s", "KEY"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{h.replace('`', '``')}` {('int', 'string', 'array<int>', 'map<string,int>')[i % 4]}" for i, h in enumerate(helpers))
    value = [7, "seven", [7], {"a": 7}]
    rows = [(i, prose(rng, 40), "en", f"s{i % 2}", 1, *(value[k % 4] for k in range(len(helpers)))) for i in range(60)]
    rows += [(100 + i, *rows[5][1:]) for i in range(10)] + [(5, rows[5][1], "en", "zz", 1, *rows[5][5:])]  # copies, and a repeated row of another source
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        found = out.collect()
        assert found and all(r[5 + i] == value[i % 4] for r in found for i in range(len(helpers)))
        kept[name] = found
        docs = spark.createDataFrame(found, schema)
    assert [r["source"] for r in kept["near_copies"] if r["doc_id"] == 5] == ["s1"]  # the first of repeated rows by their columns
    assert len(kept["near_copies"]) == 60
