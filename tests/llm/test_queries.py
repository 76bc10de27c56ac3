"""The registered queries on a small folder of odd tables, against brute force in plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import fixture_tables
import numpy as np
import public_tokenizers
import pytest
from test_dedup_join import brute
from tokenizers import Tokenizer

import lumenframe.llm as llm
from lumenframe.llm import language_id, packing, toxicity, transport_stream

DOCS, LABELS = fixture_tables.rows()
TEXTS = {d[0]: d[1] or "" for d in DOCS}


@pytest.fixture(scope="module")
def run(spark, tables):
    return lambda name: llm.queries()[name](spark, tables).toPandas()


def fold(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_every_query_takes_empty_tables(spark, empty_tables):
    for name, query in llm.queries().items():
        assert query(spark, empty_tables).count() == 0, name


def test_exact_dedup(run):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in TEXTS.items()}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    want = {(i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
    out = run("op1_exact_dedup")
    assert set(out[["doc_id", "keep_id", "group_size", "kept", "text_sha256"]].itertuples(index=False, name=None)) == want and len(out) == len(DOCS)


def test_token_counts(run):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in TEXTS.items()}
    assert set(run("op2_token_counts").itertuples(index=False, name=None)) == {(i, len(TEXTS[i].encode()), n, n > 1024) for i, n in sizes.items()}


def test_jaccard_join(run):
    want = brute([d[1] for d in DOCS], 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run("op3_jaccard_join").itertuples()} == want


def test_packing(run):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = run("op4_packing")
    check_pieces(out, {i: [[*library.encode(t, add_special_tokens=False).ids, 0]] for i, t in TEXTS.items()})
    sizes = out.groupby("sequence_id")["length"].sum()
    assert sum(n if n & n - 1 == 0 else 1024 for n in sizes) < 1.2 * out["length"].sum() + 1024 * 4


def check_pieces(pieces, ids):
    """Each document's pieces cover its ids once, sequences are gapless and hold 1024 at most."""
    for doc, own in pieces.groupby("doc_id"):
        own = own.sort_values("start")
        (have,) = ids[doc]
        assert own["start"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() == len(have) == own["doc_tokens"].iloc[0]
        for r in own.itertuples():
            assert zlib.crc32(np.array(have[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert set(pieces["doc_id"]) == set(ids)
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 1024
    assert sorted(pieces["sequence_id"].unique()) == list(range(pieces["sequence_id"].nunique()))


def test_packing_does_not_depend_on_batches(spark, tables, monkeypatch):
    want = llm.queries()["op4_packing"](spark, tables).toPandas().sort_values(["doc_id", "start"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = llm.queries()["op4_packing"](spark, tables).toPandas().sort_values(["doc_id", "start"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out.to_numpy().tolist() == want.to_numpy().tolist()


def test_streams_close_at_documents(spark, tables, monkeypatch):
    monkeypatch.setattr(packing, "STREAM_IDS", 500)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id > 6")
    out = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).toPandas()
    check_pieces(out, {i: [[*library.encode(t, add_special_tokens=False).ids, 0]] for i, t in TEXTS.items() if i > 6})


def test_language_id_by_dense_dot_products(spark, tables, run):
    df = spark.read.parquet(f"{tables}/documents.parquet")
    model = language_id.train(df.where("lang IS NOT NULL AND text IS NOT NULL AND crc32(encode(CAST(doc_id AS STRING), 'UTF-8')) % 3 <> 1").select("doc_id", "text", "lang"))
    out = {r.doc_id: r for r in run("op5_language_id").itertuples()}
    right = []
    for i, text, lang, *_ in DOCS:
        assert out[i].held_out == (fold(i, 3) == 1) and 0 <= out[i].score <= 1
        if not any(map(str.isalpha, text or "")):
            assert out[i].lang_pred == "und"
            continue
        total = np.zeros(language_id.BINS)
        for word in text.lower().split():
            np.add.at(total, language_id.grams(word), 1)
        margins = total @ model.weights / max(1, total.sum()) + model.bias
        # One family's machine, or the highest; then the votes of the pairs within.
        machines = dict(zip(model.machines, margins))
        first = {f: machines.get((f, ""), -machines.get((model.families[0], ""), 0)) for f in model.families}
        family = max(first, key=first.get)
        wins = Counter(a if machines[a, b] >= 0 else b for a, b in model.machines if b and a in model.languages[family])
        assert out[i].lang_pred == (wins.most_common(1)[0][0] if wins else model.languages[family][0])
        if fold(i, 3) == 1 and len(text) > 50 and "word" not in text:
            right.append(out[i].lang_pred == lang)
    assert len(right) > 30 and np.mean(right) > 0.9


def test_toxicity_by_plain_sums(spark, tables, run):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs.select("doc_id", "text"), toxicity.training_labels(labels))
    out, right = {r.doc_id: r for r in run("op6_toxicity").itertuples()}, []
    for i, text in TEXTS.items():
        raw, flags, strikes = model.bias, 0, 0
        times = Counter(s for word in text.split() for s in toxicity.stems(word.lower()))
        raw += sum(model.weights.get(s, 0.0) * min(n, 8) for s, n in times.items())
        for word in text.split():
            flags |= model.voters.part(word)[-1]
            strikes += model.voters.part(word)[-1] & model.voters.strikes > 0
        raw += sum(w for k, w in enumerate(model.votes[: model.voters.many]) if flags >> k & 1)
        raw += model.votes[-3] * (strikes >= toxicity.SEVERAL)
        letters, capitals = sum(map(str.isalpha, text)), sum(map(str.isupper, text))
        raw += model.votes[-2] * (letters > 20 and capitals > 0.6 * letters)
        assert abs(out[i].score - 1 / (1 + np.exp(-min(30, raw)))) < 1e-9
        assert out[i].held_out == (fold(i, 4) == 2) and out[i].predicted == int(out[i].score >= 0.3)
        right.append(out[i].predicted == int(any(b in text.split() for b in fixture_tables.BAD.values())))
    assert np.mean(right) > 0.97


def test_sharding(run):
    out = run("op7_sharding")
    sizes = Counter(out["shard"])
    assert set(out["law"]) == {"rows"} and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(own["slot"]) == list(range(len(own))) for _, own in out.groupby("shard"))
    got = {tuple(r) for r in zip(out["doc_id"], out["size"], out["text_crc32"])}
    assert got == {(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in TEXTS.items()} and out["grown_shard"].isna().all()


def test_token_output(run):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = set(), 0
    for i, t in TEXTS.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want.add((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert set(run("op8_token_output")[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None)) == want


def test_transport_stream(run):
    out = {r.doc_id: r for r in run("op10_transport_stream").itertuples()}
    for i, t in TEXTS.items():
        raw, r = t.encode(), out[i]
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = transport_stream.encode_stream(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        units = -(-len(payload) // 4096)
        assert r.feature.startswith(f"units={units};packets={len(media) // 188};random_access={-(-units // 8)};stamps=0-{(units - 1) * 3600};") and r.feature.endswith("faults=0")
