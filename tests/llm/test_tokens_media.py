"""Token counts, packing, coded output and transport streams: exact against the library and round trips."""

import json
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm import _memory, _pieces, packing, range_coder, token_counts, token_output, transport_stream
from lumenframe.llm._pieces import PieceEncoder

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [None, "", " ", "a\n\n  b", "  lead", "trail ", "<|endoftext|> x<|endoftext|>", "don't I'LL", "été\x1c ab", "日本 語です。", "Σας İ", "á é", "word " * 3000, "x" * 5000, "One. Two! Three?\nFour " * 40, "same", "same"]
GOLDEN_LONG, GOLDEN_SHORT = (6908, 558161692), "4c524332030000000a0000000100000008000000ed87779301000000075da5d6467f3731"
SCHEMA = "doc_id long, text string, N_TOKENS int, digest string, part int, key int"


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "clash", 2, 3) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def encoders():
    return {p: (PieceEncoder(p), Tokenizer.from_file(p)) for p in (BYTES, WORDS)}


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.sampled_from(list("ab cD'sé\n\t ́.!<|endoftext|>12ßΣİ\x1f 日_-")), max_size=40))
def test_pieces_equal_the_library(encoders, text):
    for own, library in encoders.values():
        want = library.encode(text, add_special_tokens=False).ids
        ids, _ = own.ids([text, "other one.", text])
        assert ids[0].tolist() == want == ids[2].tolist() and own.counts([text])[0] == len(want)


def test_counts_and_cache(spark, tmp_path):
    library, df = Tokenizer.from_file(BYTES), table(spark, TEXTS)
    cache = f"file://{tmp_path}/cache"
    for docs in (df, df):
        out = {r["doc_id"]: r for r in token_counts.token_counts(docs, BYTES, cache_path=cache, limit=100).collect()}
        for i, t in enumerate(TEXTS):
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (out[i]["n_tokens"], out[i]["n_bytes"], out[i]["over_limit"]) == (n, len((t or "").encode()), n > 100)
    assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS})  # the second pass encoded nothing
    assert token_counts.token_counts(df.limit(0), BYTES).count() == 0


def test_packing(spark):
    library = Tokenizer.from_file(BYTES)
    rows = packing.pack(table(spark, TEXTS), BYTES, capacity=64).toPandas()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(TEXTS)}
    for r in rows.itertuples():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) and r.length == len(part) > 0
    for i, own in rows.groupby("doc_id"):
        own = own.sort_values("start")
        assert (own["start"].to_numpy() == np.r_[0, np.cumsum(own["length"])[:-1]]).all() and own["length"].sum() == len(ids[i])
    for _, seq in rows.sort_values("offset").groupby("sequence_id"):
        assert (seq["offset"].to_numpy() == np.r_[0, np.cumsum(seq["length"])[:-1]]).all() and seq["length"].sum() <= 64
    assert sorted(rows["sequence_id"].unique()) == list(range(rows["sequence_id"].nunique()))
    assert packing.pack(table(spark, TEXTS).limit(0), BYTES).count() == 0


def test_cuts_are_optimal():
    rng = random.Random(3)
    for _ in range(60):
        pos = np.r_[0, np.cumsum([rng.randint(1, 16) for _ in range(rng.randint(1, 9))])]
        cost = np.array([0.0, *[rng.choice([0.0, 4.0]) for _ in pos[1:]]])

        def total(cuts):
            at, out = 0, 0.0
            for j in cuts:
                n = int(pos[j] - pos[at])
                free = n & (n - 1) == 0 and n >= 2
                out += (0 if free else 16 - n) + cost[j] + packing.SEQUENCE_COST
                at = j
            return out

        best = min(total(c) for m in range(1 << (len(pos) - 2)) for c in [[*[j for j in range(1, len(pos) - 1) if m >> (j - 1) & 1], len(pos) - 1]] if all(pos[b] - pos[a] <= 16 for a, b in zip([0, *c], c)))
        assert total(packing.choose_cuts(pos, cost, 16)) == best


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(4)
    for n in (0, 1, 63, 64, 129, 3000):
        for x in (rng.integers(0, 49408, n), np.minimum(rng.zipf(1.4, n), 49407), np.zeros(n, int)):
            block = range_coder.encode_block(x, 49408)
            assert (range_coder.decode_block(block) == x).all()
    block = range_coder.encode_block(np.arange(500) % 77, 49408)
    for at in [*range(24), 24, 60, len(block) - 5, len(block) - 1]:  # the header's fields, the bytes, the checksum
        with pytest.raises(range_coder.BlockError):
            range_coder.decode_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])
    for short in (b"", block[:20], block[:-1], block + b"x"):
        with pytest.raises(range_coder.BlockError):
            range_coder.decode_block(short)
    for ids, size in (([5], 5), ([-1], 5), ([0], 0), ([0], 1 << 20)):
        with pytest.raises(ValueError):
            range_coder.encode_block(np.array(ids), size)
    text = np.tile(rng.integers(0, 500, 2000), 20)
    assert len(range_coder.encode_block(text, 49408)) < text.size  # repeated ids cost under a byte each


def test_blocks_are_the_same_everywhere():
    """Golden bytes: integer arithmetic alone decides them."""
    ids = np.array([(i * i * 31) % 997 % (i % 50 + 1) for i in range(9000)])
    block = range_coder.encode_block(ids, 1000)
    assert (len(block), zlib.crc32(block)) == GOLDEN_LONG
    assert range_coder.encode_block(np.array([7, 3, 3]), 10).hex() == GOLDEN_SHORT


def test_other_tokenizer_files_go_to_the_library(tmp_path):
    said = json.loads(open(BYTES, encoding="utf-8").read())
    said["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "prefix.json"
    path.write_text(json.dumps(said), encoding="utf-8")
    library, own = Tokenizer.from_file(str(path)), PieceEncoder(str(path))
    assert own.cuts == "none" and (PieceEncoder(BYTES).cuts, PieceEncoder(WORDS).cuts) == ("blanks", "spaces")
    for text in ("Hello there you", "x", ""):
        assert own.ids([text])[0][0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_do_not_depend_on_marks_or_cache():
    """Token output asks for no sentence ends, and packing for a smaller cache; ids stay the library's."""
    from tokenizers import Tokenizer

    texts = ["The Cat sat. on it", "", "Éa ünder ÀB 12 x's", "naïve.  two", "one two " * 50]
    for path in (BYTES, WORDS):
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        for own in (PieceEncoder(path, marks=False), PieceEncoder(path, cache_bytes=1)):
            for _ in range(2):
                ids, marks = own.ids(texts)
                assert [x.tolist() for x in ids] == want and (own.marks or not len(marks))
                assert own.held > 0 and (own.marks or own.ends.size == 0)


def test_the_model_sees_a_word_once():
    """Token output: letters and signs of pieces are looked up before the model, whatever their case."""
    texts = ["Word word, WORD. word! été", "ÉTÉ, (word) naïve word, other.", "12 x's <|endoftext|> word<|endoftext|>. İ ŉ ﬁ"]
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    own, seen = PieceEncoder(WORDS, marks=False), []

    class Counted:
        def __init__(self, model):
            self.model = model

        def tokenize(self, word):
            seen.append(word)
            return self.model.tokenize(word)

    own.model = Counted(own.model)
    for part in (slice(0, 2), slice(1, 3)):
        assert [x.tolist() for x in own.ids(texts[part])[0]] == want[part]
    assert seen.count("word") == 1 and len(seen) == len(set(seen))


class Seen:
    """A model that notes the words it is asked for."""

    def __init__(self, model):
        self.model, self.words = model, []

    def tokenize(self, word):
        self.words.append(word)
        return self.model.tokenize(word)


def test_packing_asks_for_a_word_once():
    """Whatever its signs, and on both sides of a line end; what follows a line end is cut there instead of going to the library."""
    texts = ["Word word, (x word. word!\nOf word,\n\nOf.", "été word: other.\nOf été word"]
    want = [e.ids for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]
    own, asked = PieceEncoder(BYTES), []
    library = own.library
    own.model, own.library = Seen(own.model), lambda x: asked.extend(x) or library(x)
    ids, marks = own.ids(texts)
    assert [x.tolist() for x in ids] == want and own.model.words.count("Ġword") == 1 == own.model.words.count("Of")
    assert len(own.model.words) == len(set(own.model.words)) and set(asked) <= {" (x", ""}
    # Sentences end behind their signs, in front of the line end.
    said = [own.tokenizer.decode(np.concatenate(ids)[:m].tolist()) for m in marks]
    assert len(said) == 6 and all(map(str.endswith, said, ["word.", "word!", "Of word,", "Of word,\n", "Of.", "other."]))


def test_words_take_little_of_the_cache():
    """Token output and packing keep words as Arrow does: more than twice as many as Python strings in a dictionary."""
    words = ["".join(chr(97 + int(d)) for d in str(k * 7919)) for k in range(100, 5000)]
    for path in (BYTES, WORDS):
        own = PieceEncoder(path)
        own.ids([" ".join(words)])
        assert own.held < 110 * len(words)


@pytest.mark.parametrize("text", ["a\n", "a\n\n", "\na", "a\n\nb", "a\n\n\nb", "a \nb", "a\r\nb", "a\n\tb", "a\x85\nb", "日\n本", "a\n\n<|endoftext|>b", "a\n<|endoftext|>", "<|ENDOFTEXT|> A", "a\x1f\nb", "\x1eA b", "J\u030c I\u0307 A", "a\x00B\nc"])
def test_line_ends_and_case_as_the_library_has_them(encoders, text):
    for own, library in encoders.values():
        want = library.encode(text, add_special_tokens=False).ids
        assert own.ids([text, "œ B\nC", text])[0][2].tolist() == want == own.ids([text])[0][0].tolist() and own.counts([text])[0] == len(want)


def test_a_claim_returns_what_the_cache_before_took(monkeypatch):
    given = []
    monkeypatch.setattr(_memory, "_HELD", {})
    monkeypatch.setattr(_memory, "give_back", lambda: given.append(len(_memory._HELD)))
    for key in ("a", "a", "b"):
        _memory.claim(key, object)
    assert given == [0]  # once, with nothing held any more


def test_slices_and_caches_are_bounded(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"text": ["ab", None, "x" * 90, "", "c" * 5, "d"], "n": list(range(6))})
    parts = list(_memory.sliced(iter([batch, batch.slice(0, 0)]), "text", 10))
    assert [p.column("n").to_pylist() for p in parts] == [[0, 1], [2], [3, 4, 5]]
    monkeypatch.setattr(_pieces, "CACHE_BYTES", 1000)
    own, plain = PieceEncoder(BYTES), PieceEncoder(BYTES)
    for k in range(30):
        text = " ".join(f"w{k}x{i}" for i in range(20))
        assert own.ids([text])[0][0].tolist() == plain.library([text])[0] and len(own.index) <= 20
    first = _memory.claim("one", list)
    assert _memory.claim("one", list) is first and _memory.claim("two", dict) == {} and _memory.claim("one", list) is not first


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_IDS", 2000)
    library, path = Tokenizer.from_file(WORDS), f"file://{tmp_path}/ids"
    df = table(spark, TEXTS).orderBy("text")
    token_output.write_token_ids(df, path, WORDS, vocabulary=49408)
    out = {r["doc_id"]: r for r in token_output.read_token_ids(spark, path).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert out[i]["ids"] == ids and out[i]["start"] == start and out[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    token_output.write_token_ids(df.limit(0), f"{path}0", WORDS, vocabulary=49408)
    assert token_output.read_token_ids(spark, f"{path}0").count() == 0


def test_texts_are_read_once_for_token_files(spark, tmp_path):
    """Ranges of ids are found from the ids alone; ids that repeat, null ids and few ids keep their order."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(n):
        seen.add(1)
        return f"text {n}"

    ids = [None, 5, -7, 2**60, 5, *range(40, 90, 3), None, 5]
    rows = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "doc_id long, n long").repartition(3)
    for at, df in enumerate((rows, rows.where("n < 3"), rows.where("doc_id IS NULL"))):
        before, path = seen.value, f"file://{tmp_path}/ids{at}"
        token_output.write_token_ids(df.select("doc_id", text("n").alias("text")), path, WORDS, vocabulary=49408)
        assert seen.value - before == df.count()
        got = [r["doc_id"] for r in token_output.read_token_ids(spark, path).orderBy("start").collect()]
        assert got == sorted([r["doc_id"] for r in df.collect()], key=lambda x: (x is not None, x or 0))


def test_streams_round_trip():
    for n in [*range(0, 380), 4095, 4096, 4097, 8192, 40_000]:
        payload = os.urandom(n)
        read = transport_stream.decode_stream(transport_stream.encode_stream(payload))
        assert read.payload == payload and read.lost_sync == read.counter_errors == read.table_errors == read.unit_errors == 0
    assert read.programs == {1: 0x1000} and read.streams == {0x100: 6}
    assert read.stamps == [k * 3600 for k in range(10)] and [k for k, r in enumerate(read.random_access) if r] == [0, 8]


def test_stream_damage_is_counted():
    media = bytearray(transport_stream.encode_stream(os.urandom(20_000)))
    del media[188 * 5 : 188 * 6]
    read = transport_stream.decode_stream(bytes(media))
    assert read.counter_errors == 1 and read.unit_errors == 1 and len(read.units) == 4
    media = bytearray(transport_stream.encode_stream(b"x" * 500))
    media[10] ^= 1
    assert transport_stream.decode_stream(bytes(media)).table_errors == 1
    assert transport_stream.decode_stream(b"").payload == b"" and transport_stream.decode_stream(b"noise").lost_sync == 1


def test_stream_of_hand_written_packets():
    """A stream as other writers make it: tables with known checksums, two units, a table again, a counter that wraps."""
    def packet(head, body):
        return bytes.fromhex(head) + body + b"\xff" * (188 - len(head) // 2 - len(body))

    def unit(counter, pts, data, random_access):
        elementary = bytes.fromhex("000001e00000808005" + pts) + data  # a video unit says no length
        space = 184 - len(elementary)
        field = bytes([space - 1, 0x40 if random_access else 0]) + b"\xff" * (space - 2)
        return bytes([0x47, 0x41, 0x00, 0x30 | counter]) + field + elementary

    association = packet("47400010" + "0000b00d0001c100000001f000" + "2ab104b2", b"")
    table = packet("47500010" + "0002b0120001c10000e100f0001be100f000" + "15bd4d56", b"")
    media = association + table + unit(15, "210005bf21", b"first", True) + unit(0, "210007d861", b"second", False)
    read = transport_stream.decode_stream(media)
    assert read.programs == {1: 0x1000} and read.streams == {0x100: 0x1B}
    assert read.units == [b"first", b"second"] and read.stamps == [90_000, 126_000] and read.random_access == [True, False]
    assert read.places == [0, 3 * 188] and transport_stream.faults(read) == 0
    assert transport_stream._ASSOCIATION.tobytes() == association


def test_media_table_and_its_index(spark):
    stored = transport_stream.write_media(table(spark, TEXTS))
    moved = stored.withColumn("stamps", F.transform("stamps", lambda x: x + 1))
    assert {r["faults"] for r in transport_stream.read_media(moved).collect()} == {1}
    row = stored.where("doc_id = 12").first()
    assert row["random_access"] == [0] and row["stamps"] == [k * 3600 for k in range(4)]


def test_media_columns(spark):
    out = {r["doc_id"]: r for r in transport_stream.read_media(transport_stream.write_media(table(spark, TEXTS))).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        assert out[i]["payload"][: len(raw)] == raw and len(out[i]["payload"]) == max(64, -(-len(raw) // 64) * 64) and out[i]["faults"] == 0
    assert out[15]["payload"] == out[16]["payload"] and out[15]["feature"] == out[16]["feature"]
