"""The corpus pipeline stage by stage: each stage's result against plain Python on that stage's input."""

import hashlib
import re
from collections import defaultdict

import fixture_tables
import public_tokenizers
import pytest
from test_dedup_join import brute
from test_models_mixing import water
from test_queries import check_pieces
from tokenizers import Tokenizer

from lumenframe.llm import toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = [f.split()[0] for f in fixture_tables.SCHEMA.split(", ")]


def mixture(docs, share):
    """Ids that an even mixture of the tokens' ``share`` takes, by nested filling and prefixes of the seeded order."""
    leaf, size = defaultdict(list), {}
    for i, text, lang, source in docs:
        number = re.search(r"(\d+)$", source or "")
        size[i] = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        leaf[f"domain{int(number[1]) % 3 if number else 0}", lang or "", source or ""].append(i)
    capacity = {k: sum(size[i] for i in ids) for k, ids in leaf.items()}

    def divide(path, budget):
        if len(path) == 3:
            return {path: int(budget + 1e-6)}
        kids = sorted({k[: len(path) + 1] for k in leaf if k[: len(path)] == path})
        shares = water(budget, [(1.0, sum(c for k, c in capacity.items() if k[: len(kid)] == kid)) for kid in kids])
        return {k: v for kid, part in zip(kids, shares) for k, v in divide(kid, part).items()}

    out = set()
    for k, budget in divide((), float(int(sum(size.values()) * share))).items():
        if capacity[k] and budget // capacity[k]:
            out.update(leaf[k])
            continue
        used = 0
        for i in sorted(leaf[k], key=lambda i: (hashlib.md5(f"17|0|{i}".encode()).hexdigest()[:13], i)):
            used += size[i]
            if used > budget or budget == 0:
                break
            out.add(i)
    return out


def test_stages_against_plain_python(spark, tables, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "packing"]
    docs, seen = spark.read.parquet(f"{tables}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()
        if name != "packing":
            assert out.columns == COLUMNS
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    seen["end"] = docs.toPandas()
    kept = {name: [r["doc_id"] for r in seen[later]] for name, later in zip(seen, ["exact_dedup", "jaccard_join", "mixing", "packing"])}

    labels = spark.read.parquet(f"{tables}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text"), toxicity.training_labels(labels))
    assert kept["toxicity"] == [r["doc_id"] for r in seen["toxicity"] if model.scores([r["text"] or ""])[0] < 0.3]
    bad = {r["doc_id"] for r in seen["toxicity"] if any(b in (r["text"] or "").split() for b in fixture_tables.BAD.values())}
    assert len(bad - set(kept["toxicity"])) >= 0.9 * len(bad) and len(kept["toxicity"]) >= 0.95 * (len(seen["toxicity"]) - len(bad))

    first = {}
    for r in seen["exact_dedup"]:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert kept["exact_dedup"] == sorted(first.values()) and len(first) < len(seen["exact_dedup"])

    ids = [r["doc_id"] for r in seen["jaccard_join"]]
    components = brute([r["text"] for r in seen["jaccard_join"]], 5, 80)
    assert kept["jaccard_join"] == [ids[k] for k, (_, least) in components.items() if k == least] != ids

    want = mixture([tuple(r) for r in seen["mixing"]], corpus_pipeline.MIXTURE_FRACTION)
    assert set(kept["mixing"]) == want and len(want) < len(seen["mixing"])

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_pieces(seen["end"], {r["doc_id"]: [[*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]] for r in seen["packing"]})


def test_run_takes_all_stages_and_empty_tables(spark, tables, empty_tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert 20 < len({r["doc_id"] for r in out.select("doc_id").collect()}) < 150
    assert corpus_pipeline.run(spark, empty_tables).count() == 0
