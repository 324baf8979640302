"""Exact token ids of a word-level BPE file, by distinct words.

The tokenizer drops white space and works word by word, so a text's ids are
its words' ids in order.  A column of texts is split and its words numbered in
Arrow; the distinct ones go together through a byte-rank BPE built from the
same file, and through the file's own tokenizer where the two could differ.
Nothing is kept between columns.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks the end of a piece in the byte-rank BPE, and stands between words; neither is in a word that goes there.
END, BETWEEN = "\0", "\n"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        byte_of, suffix, end = _byte_of(), spec["model"]["end_of_word_suffix"], END.encode()

        def raw(token: str) -> bytes:
            ends = token.endswith(suffix)
            return bytes(byte_of[c] for c in (token[: -len(suffix)] if ends else token)) + end * ends

        special = {x["content"] for x in spec["added_tokens"]}
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks: dict[bytes, int] = {}
        for unit in (bytes([b]) for b in range(256)):
            ranks[unit] = len(ranks)
        # The last byte of a word and its end are one unit before any merge.
        for b in range(1, 256):
            ranks[bytes([b]) + end] = len(ranks)
        for merge in spec["model"]["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            ranks.setdefault(raw(left) + raw(right), len(ranks))
        self.ids = np.array([ids.get(t, -1) for t in ranks], np.int32)
        self.between = ranks[BETWEEN.encode()]
        self.pieces = tiktoken.Encoding("words", pat_str=rf"[^{END}{BETWEEN}]+{END}|{BETWEEN}", mergeable_ranks=ranks, special_tokens={})
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(f"{pattern}|{BETWEEN}").findall
        # Special strings, control characters, and a capital sigma, whose lower case depends on its place.
        self.odd = regex.compile("|".join([r"[\x00-\x09\x0b-\x1f\x7f-\x9f]", "\u03a3", *(regex.escape(x) for x in sorted(special))])).search

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts) of words without white space."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        text = BETWEEN.join(words.to_numpy(zero_copy_only=False))
        odd = ()
        if self.odd(text):
            every = text.split(BETWEEN)
            odd = [i for i, w in enumerate(every) if self.odd(w)]
            for i in odd:
                every[i] = ""
            text = BETWEEN.join(every)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        found = self.pieces.encode_to_numpy(END.join(self.split(text.lower())) + END, disallowed_special=())
        inner = found != self.between
        ids = self.ids[found[inner]]
        cuts = np.concatenate([[0], np.cumsum(inner)[~inner], [len(ids)]])
        unknown = np.searchsorted(cuts, np.flatnonzero(ids < 0), "right") - 1
        slow = sorted({*odd, *unknown.tolist()})
        if slow:
            parts = np.split(ids, cuts[1:-1])
            for i in slow:
                parts[i] = np.array(self.whole.encode(words[i].as_py(), add_special_tokens=False).ids, np.int32)
            ids, cuts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, cuts

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cuts): the ids of all texts in a row, and where each text's begin; a null text has none."""
        lists = pc.ascii_split_whitespace(column)
        counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
        coded = lists.flatten().dictionary_encode()
        flat, cuts = self._words(coded.dictionary)
        which = np.asarray(coded.indices)
        size = np.diff(cuts)[which]
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(cuts[which] - total[:-1], size)
        at += np.arange(total[-1])
        return flat.astype("<u2")[at], total[np.concatenate([[0], np.cumsum(counts)])]


_made: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """This worker's tokenizer of a file."""
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]
