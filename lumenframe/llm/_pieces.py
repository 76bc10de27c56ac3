"""Token ids of whole texts, with each distinct word encoded once per Python worker.

Some tokenizer files let no token cross the blank in front of a word.  Their texts are cut in front of single
blanks and line ends, and a text's ids are those of its pieces.  Which files these are is read from the file itself;
texts of any other file, and texts that can't be cut so (runs of blanks, control characters that count as white
space in Python alone), go to the library whole.  Pieces are cut and told apart by Arrow, a slice of texts at a time.
A piece of Latin letters with some signs after them, which most are, is a word and its signs: new words go to the
library's model without its text handling.  Other pieces go to the library once.  Where white space is dropped and
letters lose their case, words are looked up in lower case.
"""

from __future__ import annotations

import codecs
import gc
import json
import os
import re
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumenframe.llm._memory import CACHE_BYTES, claim, give_back

#: Bytes that the cache holds of a word or piece, besides its characters and ids, about; and of texts that are encoded at once.
PIECE_BYTES, TEXT_BYTES = 60, 8 << 20
#: In front of a text's first piece, and of pieces that follow a line end: no blank precedes either.
_FIRST, _LINE = "\x1e", "\x1f"
#: White space in Python alone: never taken as a cut.
_ODD = "\x1c\x1d\x1e\x1f"
_SPACES = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
_ALL_SPACES = _SPACES + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Signs that are one word of their own behind letters, and letters that no normalisation but lower case changes.
_SIGNS = "!\"#$%&()*+,./:;=?@[]^_`{|}~-"
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+"
_WORD = f"^[{_FIRST}{_LINE}]?{_LETTERS}\\z"  # for Arrow
_SENTENCE_END = re.compile("[.!?…。][\"')\\]»”]*$|\n")

#: What files say of which the texts can be cut.
BYTE_LEVEL = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
LOWER_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def cuts_of(config: dict) -> str:
    """``blanks`` (kept in front of words), ``spaces`` (any white space, dropped) or ``none``, for a tokenizer file's contents."""
    plain = all(t["content"].split() == [t["content"]] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in config.get("added_tokens") or [])
    if not plain or config["model"].get("dropout") or config.get("post_processor") is not None:
        return "none"
    said = {k: config.get(k) for k in BYTE_LEVEL}
    return "blanks" if said == BYTE_LEVEL else "spaces" if said == LOWER_WORDS else "none"


class _Index(dict):
    """Numbers pieces as they are met."""

    def __init__(self) -> None:
        self.pending: list = []

    def __missing__(self, piece: object) -> int:
        self[piece] = n = len(self)
        self.pending.append(piece)
        return n


class _Grown:
    """An array that grows by doubling; ``held`` may be longer than ``size``."""

    def __init__(self, kind: type) -> None:
        self.held, self.size = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(max(end, 2 * len(self.held)) - len(self.held), self.held.dtype)])
        self.held[self.size : end] = values
        self.size = end


class _Known:
    """Distinct strings met so far, and where the ids of each are."""

    def __init__(self) -> None:
        self.strings = pa.array([], pa.string())
        self.start, self.lengths, self.plain = _Grown(np.int64), _Grown(np.int64), _Grown(bool)

    def __len__(self) -> int:
        return len(self.strings)

    def find(self, strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The number of each of ``strings``, which are distinct, and those met for the first time, numbered in their order."""
        at = pc.index_in(strings, value_set=self.strings)
        numbers, fresh = at.fill_null(-1).to_numpy().astype(np.int64), strings.filter(at.is_null())
        numbers[numbers < 0] = len(self) + np.arange(len(fresh))
        self.strings = pa.concat_arrays([self.strings, fresh])
        return numbers, fresh


class _Slice:
    """What the pieces of some texts are: ``pieces`` of all texts in a row, ``counts`` a text, ids of texts encoded ``whole``."""

    def __init__(self, pieces: np.ndarray, counts: np.ndarray, whole: dict[int, list[int]]) -> None:
        self.pieces, self.counts, self.whole = pieces, counts, whole
        self.flat, self.start, self.lengths, self.ends, self.lines = np.zeros(0, np.uint32), *[np.zeros(0, np.int64)] * 2, *[np.zeros(0, bool)] * 2

    def closing(self) -> np.ndarray:
        """Whether a sentence ends behind each piece: by its signs, or as a line end follows."""
        out = self.ends.take(self.pieces)
        out[:-1] |= self.lines.take(self.pieces[1:])
        return out


def encoder(path: str, *, marks: bool = True, cache_bytes: int | None = None) -> PieceEncoder:
    """This worker's encoder of a tokenizer file; without ``marks`` it doesn't look for sentence ends."""
    return claim(("tokenizer", path, marks, cache_bytes), lambda: PieceEncoder(path, marks, cache_bytes))


class PieceEncoder:
    def __init__(self, path: str, marks: bool = True, cache_bytes: int | None = None) -> None:
        self.marks, self.cache_bytes = marks, cache_bytes
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer, pre_tokenizers

        said = Path(path).read_text(encoding="utf-8")
        self.tokenizer = Tokenizer.from_str(said)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        config = json.loads(said)
        self.cuts = cuts_of(config)
        #: Strings that part a text before anything else; where case is lost, in lower case.
        self.added = [t["content"].lower() if self.cuts == "spaces" else t["content"] for t in config.get("added_tokens") or []]
        self.model = self.tokenizer.model
        # The byte-level alphabet, by the library: what stands for the bytes of blanks, signs and letters; line ends part words.
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        alphabet = {b: c for n in (*range(0x20, 0x7F), *range(0xC0, 0x180)) for b, c in zip(chr(n).encode(), byte_level.pre_tokenize_str(chr(n))[0][0])}
        self.alphabet = "".join(alphabet.get(b, "\n" if b == 10 else "\ufffe") for b in range(256))
        self._reset()

    def _reset(self) -> None:
        #: Words (with their mark, without signs), pieces that are none, and ids of all.
        self.words, self.index, self.flat = _Known(), _Known(), _Grown(np.uint32)
        self.ends = _Grown(bool)  # of ``index``
        self.signs: dict[str, tuple[int, int, bool]] = {}  # start, length, whether they end a sentence
        self.held = 0
        self.line = self._add([self.library(["\n"])[0]])

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Keep ids; where those of each begin, and how many each has."""
        flat, lengths = _flat(ids)
        start = self.flat.size + np.cumsum(lengths) - lengths
        self.flat.add(flat)
        self.held += 4 * len(flat)
        return start, lengths

    def _by_model(self, words: str) -> list[list[int]]:
        """Ids of Latin words or signs, one a line, with the blank in front if it counts, as the library's model has them."""
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(w)] for w in codecs.charmap_decode(words.encode(), "strict", self.alphabet)[0].split("\n")]

    def _find_words(self, stems: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces without their signs; those that are no words have no ids."""
        numbers, fresh = self.words.find(stems)
        plain = pc.match_substring_regex(fresh, _WORD)
        lines = _lines(fresh.filter(plain))
        start, lengths = np.zeros((2, len(fresh)), np.int64)
        if lines:
            if self.cuts == "blanks":
                lines = f"\n{lines}".replace("\n", "\n ").replace(f" {_FIRST}", "").replace(f" {_LINE}", "")[1:]
            start[plain], lengths[plain] = self._add(self._by_model(lines))
        for grown, values in ((self.words.start, start), (self.words.lengths, lengths), (self.words.plain, plain.to_numpy(zero_copy_only=False))):
            grown.add(values)
        self.held += PIECE_BYTES * len(fresh) + _bytes(fresh)
        return numbers

    def _find_others(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces that are no word with signs."""
        numbers, fresh = self.index.find(pieces)
        new = fresh.to_pylist()
        if self.cuts == "blanks":
            new = [p[1:] if p[:1] in (_FIRST, _LINE) else f" {p}" for p in new]
        for at in range(0, len(new), 4096):
            start, lengths = self._add(self.library(new[at : at + 4096]))
            self.index.start.add(start)
            self.index.lengths.add(lengths)
        if self.marks:
            self.ends.add(np.fromiter((_SENTENCE_END.search(p) is not None for p in new), bool, len(new)))
        self.held += PIECE_BYTES * len(new) + _bytes(fresh)
        return numbers

    def _find_signs(self, signs: pa.Array) -> np.ndarray:
        """Start and length of their ids, and whether they end a sentence, in rows."""
        found = signs.dictionary_encode()
        rows = []
        for s in found.dictionary.to_pylist():
            if s not in self.signs:
                (start,), (length,) = self._add(self._by_model(s) if s else [[]])
                self.signs[s] = start, length, _SENTENCE_END.search(s) is not None
                self.held += PIECE_BYTES + len(s)
            rows.append(self.signs[s])
        return np.array(rows, np.int64).reshape(-1, 3).take(found.indices.to_numpy(), axis=0)

    def _look_up(self, out: _Slice, pieces: pa.Array, cased: bool) -> None:
        """Ids of distinct pieces: of a line end in front, of the word or the whole piece, and of the signs behind a word."""
        stems = pc.ascii_rtrim(pieces, _SIGNS)
        lower = pc.if_else(pc.match_substring_regex(stems, _WORD), pc.utf8_lower(stems), stems) if cased else stems
        found = lower.dictionary_encode()
        words = self._find_words(found.dictionary).take(found.indices.to_numpy())
        plain = self.words.plain.held.take(words)
        n = len(pieces)
        start, sizes, out.ends = np.zeros((n, 3), np.int64), np.zeros((n, 3), np.int64), np.zeros(n, bool)
        start[:, 1], sizes[:, 1] = self.words.start.held.take(words), self.words.lengths.held.take(words)
        data, at = _buffers(pieces)
        kept = np.diff(_buffers(stems)[1])
        behind, bounds = gather(data, at[:-1] + kept, np.where(plain, np.diff(at) - kept, 0))
        signs = self._find_signs(pa.StringArray.from_buffers(n, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(behind)))
        start[:, 2], sizes[:, 2] = signs[:, 0], signs[:, 1]
        others = np.flatnonzero(~plain)
        numbers = self._find_others(pieces.take(pa.array(others)))
        start[others, 1], sizes[others, 1] = self.index.start.held.take(numbers), self.index.lengths.held.take(numbers)
        out.lines = np.zeros(n, bool)
        if self.cuts == "blanks":  # no piece is empty
            out.lines = data.take(at[:-1]) == ord(_LINE)
            start[:, 0], sizes[:, 0] = self.line[0][0], self.line[1][0] * out.lines
        if self.marks:
            out.ends[:] = signs[:, 2]
            out.ends[others] = self.ends.held.take(numbers)
        out.flat, _ = gather(self.flat.held, start.ravel(), sizes.ravel())
        out.lengths = sizes.sum(axis=1)
        out.start = np.cumsum(out.lengths) - out.lengths

    def cut(self, text: str) -> str:
        """The text to cut at blanks (where they count, with marks) or any white space; empty where the library has to see it whole."""
        if self.cuts == "spaces":
            if any(c in text for c in _ODD):
                return ""
            lower = text.lower()
            return lower if _is_latin1(text) and not any(t in lower for t in self.added) else text
        spaces = _SPACES if text.isascii() else _ALL_SPACES
        found = [c for c in spaces if c in text]
        if self.cuts == "none" or _FIRST in found or _LINE in found or "  " in text or text[-1:] == " " or any(f"{c} " in text for c in found):
            return ""  # a run of white space is a piece of its own
        return _FIRST + (text.replace("\n", f" {_LINE}") if "\n" in found and self._cut_lines(text, found) else text)

    def _cut_lines(self, text: str, spaces: list[str]) -> bool:
        """Whether all line ends are pieces of their own: one or two, not at the end of what is parted, nor beside other white space."""
        beside = (f"{c}\n" in text or f"\n{c}" in text for c in spaces if c != "\n")
        return not ("\n\n\n" in text or text.endswith("\n\n") or " \n" in text or any(beside) or any(t in text for t in self.added))

    def batch(self, texts: list[str]) -> _Slice:
        """The pieces of all texts, looked up."""
        if self.held > (CACHE_BYTES if self.cache_bytes is None else self.cache_bytes):  # the cache starts afresh; results don't change
            self._reset()
            give_back()
        cuts = [self.cut(text) if text else "" for text in texts]
        whole = {i: self.library([text])[0] for i, text in enumerate(texts) if text and not cuts[i]}
        rows = np.array([i for i, c in enumerate(cuts) if c], np.int64)
        counts = np.zeros(len(texts), np.int64)
        if not len(rows):
            return _Slice(np.zeros(0, np.int64), counts, whole)
        held = pa.array([c for c in cuts if c], pa.string())
        parts = pc.utf8_split_whitespace(held) if self.cuts == "spaces" else pc.split_pattern(held, " ")
        counts[rows] = parts.value_lengths().to_numpy()
        found = parts.flatten().dictionary_encode()
        out = _Slice(found.indices.to_numpy(), counts, whole)
        gc.disable()  # so many lists that nothing refers to in circles would have it run again and again
        try:
            self._look_up(out, found.dictionary, self.cuts == "spaces" and any(c is text for c, text in zip(cuts, texts)))
        finally:
            gc.enable()
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        found = self.batch(texts)
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(found.lengths.take(found.pieces))])
        stop = np.cumsum(found.counts)
        out = total[stop] - total[stop - found.counts]
        for i, ids in found.whole.items():
            out[i] = len(ids)
        return out

    def ids(self, texts: list[str], end_id: int | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of each text (with ``end_id`` at its end), and where sentences end in all of them in a row (nowhere without marks)."""
        found = self.batch(texts)
        pieces, counts, whole = found.pieces, found.counts, found.whole
        flat, bounds = gather(found.flat, found.start.take(pieces), found.lengths.take(pieces))
        stop = np.cumsum(counts)
        edges = bounds[np.concatenate([np.zeros(1, np.int64), stop])]  # of texts, in ``flat``
        closing = found.closing() if self.marks else np.zeros(len(pieces), bool)
        extra = 0 if end_id is None else 1
        if not whole:  # end ids are put in by one copy
            marks = bounds[1:][closing]
            if extra:
                flat = np.insert(flat, edges[1:], end_id)
                if self.marks:
                    marks = marks + np.repeat(np.arange(len(counts)), counts)[closing]
                edges = edges + np.arange(len(edges))
            return [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], marks
        out, marks, at = [], [], 0
        tail = np.full(extra, end_id or 0, np.uint32)
        for i, (a, b, n) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), counts.tolist())):
            own = np.array(whole[i], np.uint32) if i in whole else flat[a:b]
            part = slice(stop[i] - n, stop[i])
            marks.append(bounds[1:][part][closing[part]] - a + at)
            out.append(np.concatenate([own, tail]))
            at += len(out[-1])
        return out, np.concatenate(marks)


def _is_latin1(text: str) -> bool:
    """Whether letters lose their case one by one, and none composes with another."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an array of strings."""
    _, bounds, data = strings.buffers()
    at = np.frombuffer(bounds, np.int32, len(strings) + 1, 4 * strings.offset).astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), at


def _bytes(strings: pa.Array) -> int:
    return pc.sum(pc.binary_length(strings)).as_py() or 0


def _lines(strings: pa.Array) -> str:
    """All strings, one a line."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings), "\n")[0].as_py()


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all lists in a row, and how many each has."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths


def gather(flat: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the slices of ``flat`` of these starts and sizes; also their bounds."""
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    index = np.repeat(start - bounds[:-1], sizes)
    index += np.arange(bounds[-1])
    return flat.take(index), bounds
