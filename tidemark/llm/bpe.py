"""Byte-level BPE with a whole-token shortcut.

A byte-level tokenizer cuts a text into pre-tokens and merges each one on its own. Offline, every
vocabulary string is put through the library's own merge step; those that come out as exactly their
own single id are *whole*. A pre-token found in that table needs no merging. The rest are merged by
the library and remembered by the worker, bounded in bytes: for counts in a table that is emptied
after each task, for ids in arrays, which are smaller and kept for the worker's next task.

Pre-tokens of texts made only of ASCII and Latin letters are cut by a compiled ``re`` pattern whose
character classes are spelled out, or for the ids of many texts at once by the same classes of their
bytes; any other text is cut by the library's own pre-tokenizer. A
vocabulary file of another kind (no byte-level rule, a normalizer, flagged special tokens, a
SentencePiece model) has no such proof, so whole texts go to its library.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Memo

# ASCII white space and Latin letters (U+00C0..U+024F without the two signs).
_SPACE = " \t\n\r\x0b\x0c"
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"

_FAST = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LATIN}]+| ?[0-9]+| ?[^{_LATIN}0-9{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_ODD = re.compile(f"[^\t\n\r\x0b\x0c\x20-\x7e{_LATIN[6:]}]")

# The same classes by byte: in a text that is not odd, every byte over 0x7F is part of a Latin letter.
_BYTE_CLASS = np.frombuffer(bytes(ord("_" if chr(b) in _SPACE else "0" if chr(b).isdecimal() else "a" if b > 0x7F or chr(b).isalpha() else "!") for b in range(256)), np.uint8)
_SHORT = np.frombuffer(b"stmd", np.uint8)
_LONG = [a << 8 | b for a, b in (b"re", b"ve", b"ll")]

#: Bytes of merged pre-tokens that a task remembers: rare ones are most of a text's kinds, and a merge costs more than the rest of the count.
MERGED_BYTES = 96 << 20
#: Bytes of the arrays of pre-tokens and their ids that a worker keeps; beyond them it begins anew from the proven ones.
KIND_BYTES = 32 << 20


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte: printable Latin-1 bytes are themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether each byte begins a pre-token, by the rule of ``_FAST``; ``begins`` are those that begin a text, none of them empty."""
    n, kind = len(data), _BYTE_CLASS[data]
    first = np.zeros(n + 1, bool)
    first[begins], first[n] = True, True
    new = first[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    # The last of several white spaces before something else stands alone, and a space goes with what follows.
    runs = np.flatnonzero(new)
    after = np.append(runs[1:], n)
    last = after[(kind[runs] == ord("_")) & ~first[after]] - 1
    new[last] = True
    new[last[data[last] == 0x20] + 1] = False
    # Contractions, where an apostrophe begins a pre-token.
    padded = np.append(data, np.zeros(2, np.uint8))
    at = np.flatnonzero(new & (data == ord("'")))
    at = at[~first[at + 1]]
    short = at[np.isin(padded[at + 1], _SHORT)]
    two = at[~first[np.minimum(at + 2, n)]]
    long = two[np.isin(padded[two + 1].astype(np.int64) << 8 | padded[two + 2], _LONG)]
    new[short + 1] = new[long + 1] = False
    ends = np.concatenate([short + 2, long + 3])
    new[ends[ends < n]] = True
    return new


class Kinds:
    """Pre-tokens and their ids as arrays: text, the ids of all one after another, where those of each begin and how many they are."""

    def __init__(self, text: pa.Array, ids: np.ndarray, n: np.ndarray):
        self.text, self.ids, self.n, self.begin = text, ids, n, np.cumsum(n) - n

    def __add__(self, more: Kinds) -> Kinds:
        return Kinds(pa.concat_arrays([self.text, more.text]), np.concatenate([self.ids, more.ids]), np.concatenate([self.n, more.n]))

    @property
    def held(self) -> int:
        return self.text.nbytes + self.ids.nbytes + 16 * len(self.n)


class Bpe:
    """One vocabulary file; ``shortcut`` tells whether the whole-token proof applies to it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.shortcut, self.sp, self.kinds = path, False, None, None
        if path.endswith(".model"):
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.width = 2 if self.sp.get_piece_size() <= 1 << 16 else 4
            return
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.width = 2 if self.tok.get_vocab_size(True) <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
        self.shortcut = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not spec.get("normalizer")
            and model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
            and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not self.shortcut:
            return
        self.special = {t["content"]: t["id"] for t in added}
        self.special_rx = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if added else None
        self.to_shown = byte_alphabet()
        self.shown_table = str.maketrans({chr(b): c for b, c in self.to_shown.items()})
        self.whole = self._prove(model["vocab"])

    @functools.cached_property
    def proven(self) -> Kinds:
        """The whole tokens and the special strings."""
        fixed = self.whole | self.special
        return Kinds(pa.array([k.encode("utf-8") for k in fixed], pa.binary()), np.array([*fixed.values()], f"<u{self.width}"), np.ones(len(fixed), np.int64))

    @functools.cached_property
    def counts(self) -> Memo:
        return Memo(lambda piece: len(self._merge(piece)), dict.fromkeys(self.whole, 1), MERGED_BYTES)

    def forget(self) -> None:
        """Drops merged pre-tokens: of the counts all, of the ids those beyond what a worker keeps. The proven ones stay."""
        if "counts" in self.__dict__:
            self.counts.forget()
        if self.kinds is not None and self.kinds.held > KIND_BYTES:
            self.kinds = None

    def _prove(self, vocab: dict[str, int]) -> dict[str, int]:
        """Text of each vocabulary entry that the merge step leaves as its own single id."""
        byte_of = {c: b for b, c in self.to_shown.items()}
        merge, whole = self.tok.model.tokenize, {}
        for shown, i in vocab.items():
            if shown in self.special or any(c not in byte_of for c in shown):
                continue
            try:
                text = bytes(byte_of[c] for c in shown).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if [t.id for t in merge(shown)] == [i]:
                whole[text] = i
        return whole

    def _merge(self, piece: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.shown_table))]

    def pieces(self, text: str) -> list[str]:
        if _ODD.search(text) is None:
            return _FAST.findall(text)
        return [text[a:b] for _, (a, b) in self._library_cuts(text)]

    def _library_cuts(self, text: str):
        return self.tok.pre_tokenizer.pre_tokenize_str(text)

    def _segments(self, text: str) -> list[tuple[str, str]]:
        """(ordinary text, the special string after it or '')"""
        out, at = [], 0
        if self.special_rx is not None:
            for m in self.special_rx.finditer(text):
                out.append((text[at : m.start()], m.group()))
                at = m.end()
        return [*out, (text[at:], "")]

    def count(self, text: str) -> int:
        if not self.shortcut:
            return len(self._library(text))
        total, get = 0, self.counts.__getitem__
        for part, special in self._segments(text):
            total += sum(map(get, self.pieces(part))) + bool(special)
        return total

    def encode(self, text: str) -> bytes:
        """Little-endian ids of ``width`` bytes each."""
        return self.encode_all([text])[0].tobytes()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts one after another, and where those of each text end."""
        if not self.shortcut:
            each = [np.array(self._library(t), f"<u{self.width}") for t in texts]
            return np.concatenate([np.zeros(0, f"<u{self.width}"), *each]), np.cumsum([len(x) for x in each], dtype=np.int64)
        cut, ends = self._cut_all(texts)
        kind = self._kinds_of(cut)
        n = self.kinds.n[kind]
        upto = np.cumsum(n)
        at = np.arange(n.sum()) + np.repeat(self.kinds.begin[kind] - (upto - n), n)
        return self.kinds.ids[at], np.append(0, upto)[ends]

    def _cut_all(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pre-tokens and special strings of many texts, and how many there are up to the end of each text."""
        raw, cuts, ends = [], [], []  # by segment: its bytes, the lengths of its pieces if not cut by class; by text: the segments up to its end
        for t in texts:
            for part, special in self._segments(t):
                raw.append(part.encode("utf-8"))
                cuts.append(None if _ODD.search(part) is None else [len(x.encode("utf-8")) for x in self.pieces(part)])
                if special:
                    raw.append(special.encode("utf-8"))
                    cuts.append([len(raw[-1])])
            ends.append(len(raw))
        sizes = np.array([len(x) for x in raw], np.int64)
        upto, data = np.cumsum(sizes), np.frombuffer(b"".join(raw), np.uint8)
        new = _starts(data, (upto - sizes)[sizes > 0])
        for k, lengths in enumerate(cuts):
            if lengths is not None:
                begin = int(upto[k]) - len(raw[k])
                new[begin : upto[k]] = False
                new[begin + np.cumsum([0, *lengths[:-1]])] = True
        starts = np.flatnonzero(new)
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return pieces, np.searchsorted(starts, np.append(0, upto)[np.array(ends, np.int64)])

    def _kinds_of(self, cut: pa.Array) -> np.ndarray:
        """The place of each pre-token in ``kinds``, to which those not met before are added."""
        if self.kinds is None or self.kinds.held > KIND_BYTES:
            self.kinds = self.proven
        kind = pc.fill_null(pc.index_in(cut, value_set=self.kinds.text), -1).to_numpy().astype(np.int64)
        missing = kind < 0
        if missing.any():
            met = cut.filter(pa.array(missing)).dictionary_encode()
            kind[missing] = met.indices.to_numpy() + np.int64(len(self.kinds.n))
            merge, at = self.tok.model.tokenize, np.append(0, np.cumsum(pc.binary_length(met.dictionary).to_numpy())).tolist()
            shown = b"".join(met.dictionary.to_pylist()).decode("latin-1").translate(self.shown_table)
            each = [[t.id for t in merge(shown[i:j])] for i, j in zip(at, at[1:])]
            self.kinds += Kinds(met.dictionary, np.array([i for ids in each for i in ids], f"<u{self.width}"), np.array([len(ids) for ids in each], np.int64))
        return kind

    def _library(self, text: str) -> list[int]:
        return self.sp.encode(text) if self.sp else self.tok.encode(text, add_special_tokens=False).ids


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One per worker process and file."""
    return Bpe(path)
