"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a hash of the eight bytes before a blank says so, so equal passages of different documents give
equal chunks wherever they stand. A worker encodes each chunk once and keeps its ids. A missed chunk is put together
from its pieces between blanks, which are kept in the same way, if the tokenizer's own rules drop blanks before they
merge; else the library encodes the whole chunk. Every join of two chunks is then checked: the words on both sides
are encoded together by the library and compared with what the join has; where they differ the two chunks become one,
which is encoded again, and its own joins are checked, until all agree. Checked joins are kept too.

All kept results have bounded number and are forgotten by generations; nothing depends on their presence.

Nulls and odd rows: a null text is an empty one: no ids, an empty decoded text; repeated rows come out as often as
they went in; special tokens' strings in a text are encoded as the library does; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, in_slices, tidy, worker_held

#: ASCII marks that end words, and ASCII letters and digits, by byte.
MARKS = b".,;:!?*&%$#"
IS_MARK = np.isin(np.arange(256), list(MARKS))
IS_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
IS_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])


class Kept:
    """A bounded mapping of two generations: what is found in the old one moves to the young one."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def many(self, keys: list) -> list:
        """Values in order, None where there is none."""
        values = list(map(self.young.get, keys))
        if None in values:
            old = self.old.get
            for k, v in enumerate(values):
                if v is None and (v := old(keys[k])) is not None:
                    self.put(keys[k], v)
                    values[k] = v
        return values

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


Entry = tuple[int, bytes, bytes]


class Encoder:
    """encode() gives each text's number of ids, the ids as decimal text, and the decoded text, both as bytes."""

    def __init__(self, source: str, mean_words: int = 128, pieces: int = 200_000, chunks: int = 3_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        rules = json.loads(source)
        self.plain_decode = rules.get("decoder") is None
        self.drops_blanks, self.lowers = self._traits(rules)
        self.names = {i: t.encode("utf-8") for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.shift = np.uint64(64 - max(0, mean_words.bit_length() - 1))
        self.decimals = {i: str(i).encode() for i in self.names}
        self.words, self.chunks, self.joins = Kept(pieces), Kept(chunks), Kept(pieces // 8)

    @staticmethod
    def _traits(rules: dict) -> tuple[bool, bool]:
        """Whether pre-tokenization keeps only pieces without blanks and nothing before it moves text over blanks; whether it lowers case."""
        pre, norm = rules.get("pre_tokenizer") or {}, rules.get("normalizer") or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        steps = {n["type"] for n in (norm.get("normalizers") or [norm]) if n}
        pattern = first.get("pattern", {}).get("Regex", "")
        split = first.get("type") == "Split" and first.get("invert") is True and first.get("behavior") == "Removed"
        return split and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in pattern and " " not in pattern and steps <= {"NFC", "Replace", "Lowercase"}, "Lowercase" in steps

    def _ids(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids

    def _entry(self, ids: list[int]) -> Entry:
        return len(ids), b" ".join(map(self.decimals.__getitem__, ids)), b" ".join(map(self.names.__getitem__, ids))

    def _fresh(self, pieces: list[bytes]) -> dict[bytes, Entry]:
        """Entries by the library. Plain pieces are encoded side by side in one call and told apart by their offsets."""
        out, plain, texts = {}, [], []
        for piece in pieces:
            text = piece.decode("utf-8", "surrogatepass")
            if b"<|" in piece or not (piece.isascii() or unicodedata.is_normalized("NFC", text)):
                out[piece] = self._entry(self._ids(piece))
            else:
                plain.append(piece), texts.append(text)
        for k in range(0, len(plain), 128):
            part = texts[k : k + 128]
            encoded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0] + [len(t) + 1 for t in part])
            at = np.searchsorted(starts, [a for a, _ in encoded.offsets], "right") - 1
            cuts = np.searchsorted(at, np.arange(len(part) + 1)).tolist()
            ids = encoded.ids
            for j, piece in enumerate(plain[k : k + 128]):
                out[piece] = self._entry(ids[cuts[j] : cuts[j + 1]])
        return out

    @staticmethod
    def _sum(entries: list[Entry]) -> Entry:
        entries = [e for e in entries if e[0]]
        return sum([e[0] for e in entries]), b" ".join([e[1] for e in entries]), b" ".join([e[2] for e in entries])

    def prepared(self, text: str) -> bytes:
        """The text in UTF-8. If blanks are dropped, with a blank wherever a mark follows a letter or digit, which
        pre-tokenization takes apart anyway, and A-Z in lower case where the tokenizer does that and no letter can
        combine with what follows it; so words with and without marks are the same piece."""
        data = text.encode("utf-8", "surrogatepass")
        if not self.drops_blanks:
            return data
        low = data.lower()
        if self.lowers and low != data and b"<" not in data:
            if text.isascii() or unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low.decode("utf-8", "surrogatepass")):
                data = low
        raw = np.frombuffer(data, np.uint8)
        at = np.flatnonzero(IS_MARK[raw[1:]]) + 1
        before = raw[at - 1]
        latin = (raw[np.maximum(at - 2, 0)] == 0xC3) & (at > 1) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)  # U+00C0 to U+00FF but the two signs
        at = at[IS_ALNUM[before] | latin]
        return np.insert(raw, at, 32).tobytes() if len(at) else data

    def cut(self, data: bytes) -> list[bytes]:
        """Chunks; each but the first begins with a blank."""
        raw = np.frombuffer(data, np.uint8)
        at = np.flatnonzero((raw == 32) | (raw == 10))
        at = at[at >= 8]
        if not self.drops_blanks:  # single spaces between words only, as the check of a join puts one there
            at = at[(raw[at] == 32) & (at + 1 < len(raw))]
            at = at[~IS_BLANK[raw[at - 1]] & ~IS_BLANK[raw[at + 1]]]
        if not len(at):
            return [data]
        last8 = np.lib.stride_tricks.sliding_window_view(raw, 8)[at - 8].copy().view("<u8")[:, 0]
        hit = at[(last8 * np.uint64(0x9E3779B97F4A7C15)) >> self.shift == 0].tolist()
        return [data[a:b] for a, b in zip([0, *hit], [*hit, len(data)], strict=True)]

    def _entries(self, chunks: list[bytes]) -> dict[bytes, tuple[Entry, bytes, bytes]]:
        """(entry, first word, last word) of each chunk."""
        distinct = list(dict.fromkeys(chunks))
        out = dict(zip(distinct, self.chunks.many(distinct), strict=True))
        missed = [c for c, e in out.items() if e is None]
        split = [c.split() for c in missed]
        if self.drops_blanks:
            values = self._words([w for words in split for w in words])
            ends = np.cumsum([0] + [len(w) for w in split]).tolist()
            entries = [self._sum(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        else:
            entries = [self._entry(self._ids(c)) for c in missed]
        for c, words, entry in zip(missed, split, entries, strict=True):
            out[c] = (entry, words[0], words[-1]) if words else (entry, b"", b"")
            self.chunks.put(c, out[c])
        return out

    def _joins(self, pairs: list[tuple[bytes, bytes]]) -> dict[tuple[bytes, bytes], bool]:
        """For pairs of words on the two sides of a join: whether the library encodes them together as they were encoded apart.

        Many pairs are encoded in one text; only where that differs, each of them by itself.
        """
        pairs = list(dict.fromkeys(pairs))
        known = dict(zip(pairs, self.joins.many(pairs), strict=True))
        new = [p for p, v in known.items() if v is None]
        for k in range(0, len(new), 64):
            some = new[k : k + 64]
            words = [w for p in some for w in p]
            if self.drops_blanks:
                apart = self._sum(self._words(words))
                same = self._entry(self._ids(b" ".join(words)))[1] == apart[1]
            else:
                same = False
            for p in some:
                known[p] = same or self._ids(b" ".join(p)) == [*self._ids(p[0]), *self._ids(b" " + p[1])]
                self.joins.put(p, known[p])
        return known

    def _words(self, words: list[bytes]) -> list[Entry]:
        values = self.words.many(words)
        if None not in values:
            return values
        fresh = self._fresh(list(dict.fromkeys([w for w, e in zip(words, values, strict=True) if e is None])))
        for w, e in fresh.items():
            self.words.put(w, e)
        return [fresh[w] if e is None else e for w, e in zip(words, values, strict=True)]

    def _repaired(self, chunks: list[bytes], found: list[tuple[Entry, bytes, bytes]], agrees) -> list[tuple[Entry, bytes, bytes]]:
        """The chunks' entries, where joins that differ are encoded again with both sides, until all joins agree."""
        k, chunks = 1, list(chunks)
        while k < len(found):
            pair = (found[k - 1][2], found[k][1])
            if all(pair) and not agrees(pair):
                chunks[k - 1 : k + 1] = [chunks[k - 1] + chunks[k]]
                found[k - 1 : k + 1] = [(self._entry(self._ids(chunks[k - 1])), found[k - 1][1], found[k][2])]
                k = max(1, k - 1)
            else:
                k += 1
        return found

    def encode(self, texts: list[str]) -> list[Entry]:
        cuts = [self.cut(self.prepared(t)) for t in texts]
        of = self._entries([c for chunks in cuts for c in chunks])
        found = [[of[c] for c in chunks] for chunks in cuts]
        joins = self._joins([(a[2], b[1]) for f in found for a, b in zip(f, f[1:], strict=False) if a[2] and b[1]])
        out = []
        for chunks, own in zip(cuts, found, strict=True):
            if not all(joins[a[2], b[1]] for a, b in zip(own, own[1:], strict=False) if a[2] and b[1]):
                own = self._repaired(chunks, own, lambda p: self._joins([p])[p])
            n, ids, decoded = self._sum([f[0] for f in own])
            if not self.plain_decode:
                decoded = self.tokenizer.decode(list(map(int, ids.split())), skip_special_tokens=False).encode("utf-8", "surrogatepass")
            out.append((n, ids, decoded))
        return out


def _mapped(docs: DataFrame, id_col: str, text_col: str, tokenizer_file: str, row, names: list[str], kinds: list[pa.DataType], schema: str) -> DataFrame:
    with open(tokenizer_file, encoding="utf-8") as f:
        source = f.read()
    shared, key = docs.sparkSession.sparkContext.broadcast(source), hashlib.sha256(source.encode()).hexdigest()
    rows = docs.select(F.col(id_col).alias("doc_id"), as_text(text_col).alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_held(f"bpe {key}", lambda: Encoder(shared.value))
        for batch in batches:
            for part in in_slices(batch, "text", 1 << 20):
                out = [row(*e) for e in encoder.encode(part.column("text").to_pylist())]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {schema}")


def encode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded): what the tokenizers library's encode and decode give, specials not added."""

    def row(n: int, ids: bytes, decoded: bytes):
        return np.array(ids.split(), np.int32), decoded.decode("utf-8", "surrogatepass")

    return _mapped(docs, id_col, text_col, tokenizer_file, row, ["ids", "decoded"], [pa.list_(pa.int32()), pa.string()], "ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), without sending the ids through the JVM."""

    def row(n: int, ids: bytes, decoded: bytes):
        return n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return _mapped(docs, id_col, text_col, tokenizer_file, row, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
