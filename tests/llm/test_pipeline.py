"""The pipeline on a small folder of tables: each stage against what its operator's brute force says of the stage's own input."""

import random

import corpus_pipeline
from quillon.llm import secrets
from quillon.llm.common import materialize


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "ba de ki lo mu na po ri sa tu".split() for b in "ren dal mik tos vup".split()]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    shared = text(60)
    rows, labels = [], []
    for i in range(60):
        t = "\n".join([text(50), text(30), *([shared] if i % 7 == 0 else []), text(50)])
        if i % 10 == 9:  # junk
            t = " ".join(w + "%%%" for w in t.split())
        if i == 20:
            t += " password=abcdefgh12"
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, int(i % 10 != 9), 0))
    near = rows[3][1].replace("\n", " ").split(" ")
    near[40] = "changed"
    rows.append((100, " ".join(near), "en", "s1", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, str(tmp_path)), name)
        seen[name] = {r["doc_id"]: r for r in out.collect()} if name != "packing" else out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    assert set(seen["quality"]) == {i for i in range(60) if i % 10 != 9} | {100}
    assert [i for i, r in sorted(seen["line_dedup"].items()) if shared in r["text"]] == [0]
    assert set(seen["line_dedup"]) == set(seen["quality"]) and 100 in seen["line_dedup"]
    assert set(seen["near_dedup"]) == set(seen["quality"]) - {100}
    assert "[SECRET]" in seen["secrets"][20]["text"] and not any(secrets.scan(r["text"]) for r in seen["secrets"].values())
    assert {r["doc_id"] for r in seen["packing"]} == set(seen["secrets"])
