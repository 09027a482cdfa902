"""The pipeline's stages, each against a plain version of it on what the stage before kept."""

from __future__ import annotations

import re
from collections import Counter

from factloom.llm import langid, mixing, simhash

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return ITEM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_stages(spark):
    import corpus_pipeline as pipeline

    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    items = [_words(r["text"]) for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()]
    stages, kept = dict(pipeline.STAGES), {}
    assert list(stages) == ["language", "dedup", "decontamination", "secrets", "mix"]
    for name, stage in stages.items():
        out = stage(spark, docs, base)
        assert name == "mix" or out.columns == docs.columns
        if name != "mix":
            out.write.mode("overwrite").parquet(f"/tmp/checkpoints/test-pipeline/{name}")
            out = spark.read.parquet(f"/tmp/checkpoints/test-pipeline/{name}")
        before, kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}, out.collect()
        got = {r["doc_id"] for r in kept[name]}
        if name == "language":
            unknown = {r["doc_id"] for r in langid.identified(docs).where("lang_pred = 'und'").collect()}
            assert got <= set(before) - unknown and len(got) > 0.95 * len(before)
        elif name == "dedup":
            prints, label = {k: simhash.fingerprint(t) for k, t in before.items()}, {k: k for k in before}
            changed = True
            while changed:
                changed = False
                for a in label:
                    low = min(label[b] for b in label if (prints[a] ^ prints[b]).bit_count() <= 3)
                    changed, label[a] = changed or low < label[a], min(low, label[a])
            assert got == set(label.values()) and len(got) < len(before)
        elif name == "decontamination":
            windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9)) if w}
            sizes = {len(w) for w in windows}
            hit = {k for k, t in before.items() for w in [_words(t)] for n in sizes for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in windows}
            assert got == set(before) - hit and hit
        elif name == "secrets":
            assert got == set(before)  # no secrets at this size, so one is planted
            row = docs.limit(1).selectExpr(*[{"doc_id": "1000000L doc_id", "text": "'we had password = abcdef123456 here' text"}.get(c, c) for c in docs.columns])
            found = {r["doc_id"]: r["text"] for r in stage(spark, docs.unionByName(row), base).collect()}
            assert found.keys() == before.keys() | {1000000} and "abcdef123456" not in found[1000000] and found[1000000].startswith("we had ")
        else:
            plan = {r["doc_id"]: r for r in mixing.mix_plan(docs).collect()}
            taken = Counter()
            for r in kept[name]:
                taken[r["doc_id"]] += r["mix_words"]
                assert r["mix_words"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
            assert all(taken[k] <= 2 * r["size"] for k, r in plan.items())
            for source in {r["source"] for r in plan.values()}:
                mine = [r for r in plan.values() if r["source"] == source]
                gap = mine[0]["target"] - sum(taken[r["doc_id"]] for r in mine)
                assert -1 <= gap <= min([r["size"] for r in mine if 0 < r["size"] and taken[r["doc_id"]] < 2 * r["size"]] or [1])
        docs = out
    assert Counter(r["doc_id"] for r in pipeline.run(spark, base).collect()).keys() == Counter(r["doc_id"] for r in kept["mix"]).keys()
