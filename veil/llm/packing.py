"""Packing of tokenized documents into windows by minimum bin slack.

A document is cut at every full window; what remains is shorter than one. Remainders of a group are a multiset of lengths. A window starts
with the longest length left, then a bitset (bit s: sum s can be reached) takes in one length after the other, longest first, until the
window can be filled; the sums a length added are kept, so that the chosen counts can be traced back. Without an exact fill the sum with
the least padding wins.
"""

from __future__ import annotations

import sys
import types
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from veil.llm.common import query, small_batches, stored, table, tidy

PIECE = "start long, length long, ids_crc32 long, doc_tokens long"
CACHE = 5 << 17
#: Bytes of text encoded together.
AT_ONCE = 1 << 18
#: Bytes of rows sent to a Python worker together.
BATCH = 1 << 22
GROUP = 4096


class Ids:
    """Token ids of texts by a tokenizer that lower-cases, drops white space and ends the last token of each part with ``</w>``.

    Texts are taken apart as the tokenizer would (letters, one digit, other signs) in arrays of bytes, by the kinds of their characters. Each
    distinct part is encoded once and kept. Words between blanks in which case, composition or a special form could matter are kept whole.
    """

    UNSEEN, BLANK, LETTER, DIGIT, SIGN, ODD = range(6)

    def __init__(self, tokenizer: str, end_id: int, cache: int = CACHE):
        self.tokenizer, self.end_id, self.known, self.cache = Tokenizer.from_str(tokenizer), np.array([end_id], "<u4"), {}, cache
        self.old: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.kinds, self.lower = np.zeros(sys.maxunicode + 1, np.uint8), np.zeros(sys.maxunicode + 1, "<u4")
        self.look_at(range(128))
        self.ascii_kinds = self.kinds[:256].tobytes()

    @classmethod
    def kept(cls, tokenizer: str, end_id: int, cache: int = CACHE) -> Ids:
        """The one of this Python worker, which serves many tasks; code that travels by value has no module of its own to keep it in."""
        store = sys.modules.setdefault("_kept_token_ids", types.ModuleType("_kept_token_ids")).__dict__
        name = f"{xxhash.xxh64_hexdigest(tokenizer)}:{end_id}:{cache}"
        if name not in store:
            store[name] = cls(tokenizer, end_id, cache)
        return store[name]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: empty) with the end id."""
        texts = [text or b"" for text in texts.cast(pa.large_binary()).to_pylist()]
        ids, starts, size = map(np.concatenate, zip(*(self.encoded(part, at) for at, part in self.slices(b"\n".join(texts)))))
        stops = np.concatenate([[0], np.cumsum(size)])
        ends = [0, *stops[np.searchsorted(starts, np.cumsum([len(text) + 1 for text in texts]))].tolist()]
        return [np.append(ids[a:b], self.end_id) for a, b in zip(ends, ends[1:])]

    @staticmethod
    def slices(text: bytes, most: int = 2 * AT_ONCE) -> Iterator[tuple[int, bytes]]:
        """(place, part) of a text, cut at blanks where there are any if it is long."""
        at = 0
        while len(text) - at > most:
            end = max(text.rfind(blank, at + 1, at + most) for blank in (b" ", b"\n"))
            if end < 0:
                end = min((e for e in (text.find(blank, at + most) for blank in (b" ", b"\n")) if e > 0), default=len(text))
            yield at, text[at:end]
            at = end
        yield at, text[at:]

    def encoded(self, text: bytes, place: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text, and of each part where it starts (the text itself at ``place``) and how many ids it has. Parts are numbered in Arrow;
        only the distinct ones meet the dictionary."""
        raw, lower = np.frombuffer(text, np.uint8), np.frombuffer(bytearray(text.lower()), np.uint8)
        kinds = np.frombuffer(bytearray(text.translate(self.ascii_kinds)), np.uint8)
        if not text.isascii():
            high = raw > 127
            points = np.frombuffer(raw[high].tobytes().decode().encode("utf-32-le"), "<u4")
            kind = self.kinds[points]
            if not kind.all():
                self.look_at(np.unique(points[kind == self.UNSEEN]).tolist())
                kind = self.kinds[points]
            kinds[high] = np.repeat(kind, self.width(points))
            lower[high] = np.frombuffer(self.lower[points].tobytes().decode("utf-32-le").encode(), np.uint8)
        odd = kinds == self.ODD
        if any_odd := bool(odd.any()):  # the words between blanks that hold one are taken whole
            blanks = np.concatenate([[-1], np.flatnonzero(kinds == self.BLANK), [len(raw)]])
            word = np.unique(np.searchsorted(blanks, np.flatnonzero(odd)))
            change = np.zeros(len(raw) + 1, np.int8)
            change[blanks[word - 1] + 1], change[blanks[word]] = 1, -1
            odd = np.cumsum(change[:-1], dtype=np.int8).view(bool)
            kinds[odd], lower[odd] = self.ODD, raw[odd]
        there = kinds != self.BLANK
        first = kinds == self.DIGIT
        first[1:] |= kinds[1:] != kinds[:-1]
        first[:1] = True
        first &= there & ((raw & 0xC0) != 0x80)
        starts = np.flatnonzero(first)
        body = lower[there]
        offsets = np.append(np.flatnonzero(first[there]), len(body))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        number = parts.indices.to_numpy()
        codes = self.codes(parts.dictionary.to_numpy(zero_copy_only=False).tolist(), np.unique(number[kinds[starts] == self.ODD]).tolist() if any_odd else [])
        ids = np.frombuffer(b"".join(codes), "<u4")
        size = np.fromiter(map(len, codes), np.int64, len(codes)) >> 2
        at = np.cumsum(size) - size
        size = size[number]
        ids = ids[np.repeat(at[number] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        return ids, starts + place, size

    @staticmethod
    def width(points: np.ndarray) -> np.ndarray:
        """Bytes of code points in UTF-8."""
        return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)

    def look_at(self, points: Iterable[int]) -> None:
        """Kinds and lower-case forms of code points; one whose form has another length in UTF-8 is odd."""
        for point in points:
            char, low = chr(point), chr(point).lower()
            self.lower[point] = point
            if char in " \t\n\r":
                self.kinds[point] = self.BLANK
            elif char in "'<\u03a3" or not self.simple(char) or not self.simple(low) or len(low.encode()) != len(char.encode()):
                self.kinds[point] = self.ODD
            else:
                self.lower[point] = ord(low)
                self.kinds[point] = {"L": self.LETTER, "N": self.DIGIT}.get(unicodedata.category(char)[0], self.SIGN)

    @staticmethod
    def simple(char: str) -> bool:
        """One character that is composed and does not combine with others."""
        return (len(char) == 1 and char.isprintable() and unicodedata.is_normalized("NFC", char) and not unicodedata.category(char).startswith("M")
                and not unicodedata.combining(char) and not "\u1160" <= char <= "\u11ff")

    def codes(self, distinct: list[bytes], whole: list[int]) -> list[bytes]:
        """Ids of each part as bytes; those numbered by ``whole`` are words."""
        if len(self.known) > self.cache:  # parts in use move to the new generation, the others go with the old one
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        codes = list(map(known.get, distinct))
        new = [i for i, code in enumerate(codes) if code is None]
        if old:
            for i in new:
                codes[i] = old.get(distinct[i])
            known.update({distinct[i]: codes[i] for i in new if codes[i] is not None})
            new = [i for i in new if codes[i] is None]
        words = set(whole).intersection(new)
        self.learn([distinct[i] for i in new if i not in words], [distinct[i] for i in words])
        for i in new:
            codes[i] = known[distinct[i]]
        return codes

    def learn(self, parts: list[bytes], words: list[bytes]) -> None:
        if parts:
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(parts).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(parts):
                raw = ids.tobytes()
                self.known.update(zip(parts, [raw[a:b] for a, b in zip([0, *stops], stops)]))
            else:
                words = parts + words
        for word, code in zip(words, self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)):
            self.known[word] = np.array(code.ids, "<u4").tobytes()


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int = 1, cache: int = CACHE, keep: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document cut at full windows; a null text has the end id only.

    ``tokenizer`` is a tokenizer's JSON; it must drop white space, so that words can be encoded apart. About twice ``cache`` encoded words are
    kept in a Python worker; fewer cost time, the ids are the same. Without ``keep`` they go with their task, so a worker that serves other
    steps after it holds none.
    """
    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = (Ids.kept if keep else Ids)(tokenizer, end_id, cache)
        for batch in batches:
            owner, rows = [], []
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            cuts = np.flatnonzero(np.diff((np.cumsum(size, dtype=np.int64) - size) // AT_ONCE, prepend=-1)).tolist()
            for at, end in zip(cuts, [*cuts[1:], batch.num_rows]):
                for n, ids in enumerate(encode(batch.column("text")[at:end]), at):
                    for start in range(0, len(ids), window):
                        part = ids[start:start + window]
                        owner.append(n)
                        rows.append((start, len(part), crc(part), len(ids)))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECE}")


def padding(used: int, window: int) -> int:
    """Tokens of padding: none at a power of two."""
    return 0 if used & (used - 1) == 0 else window - used


def fill(left: np.ndarray, window: int) -> dict[int, int]:
    """Length -> count of the window that starts with the longest length left and has the least padding. ``left[s]``: how many of length s."""
    longest = int(np.flatnonzero(left)[-1])
    room = window - longest
    reach, target, full = 1, 1 << room, (1 << room + 1) - 1
    added: list[tuple[int, int]] = []  # (length, sums beside the longest that its next copy made reachable)
    for s in np.flatnonzero(left[:room + 1])[::-1].tolist():
        for _ in range(min(int(left[s]) - (s == longest), room // s)):
            new = (reach << s) & full & ~reach
            if not new:
                break
            added.append((s, new))
            reach |= new
            if reach & target:
                break
        if reach & target:
            break
    sums = [room] if reach & target else [u for u in range(room + 1) if reach >> u & 1]
    at = min(sums, key=lambda u: (padding(longest + u, window), -u))
    counts = {longest: 1}
    for s, new in reversed(added):
        if new >> at & 1:
            counts[s] = counts.get(s, 0) + 1
            at -= s
    return counts


def windows_of(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces, given their lengths (1 to window)."""
    by_length = {int(s): np.flatnonzero(lengths == s)[::-1].tolist() for s in np.unique(lengths)}
    left = np.bincount(lengths, minlength=window + 1)
    sequence, offset, number = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while left.any():
        at = 0
        for s, n in fill(left, window).items():
            for _ in range(n):
                i = by_length[s].pop()
                sequence[i], offset[i] = number, at
                at += s
            left[s] -= n
        number += 1
    return sequence, offset


def packed(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, cache: int = CACHE, keep: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every token of every row in exactly one sequence.

    Full windows are sequences of their own. Remainders are dealt evenly into groups of about ``GROUP`` pieces, so no task grows with the
    input; a group's two windows with the most padding are dealt again among 1/64 as many groups, until one group is left. Repeated rows and
    null ids are packed like others; an empty table gives no rows. A sequence id joins round, group and number; ids are not consecutive.
    """
    with small_batches(docs.sparkSession, BATCH):
        rows = stored(pieces(docs, tokenizer, window, end_id, cache, keep), "pieces")
    whole = rows.where(F.col("length") == window).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = rows.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // GROUP))
    done, level = [whole], 0
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECE}, sequence_id long, offset long, settled boolean"
    while True:
        dealt = rest.withColumn("part", F.floor(F.rand(level) * groups))
        out = stored(dealt.groupBy("part").applyInArrow(_packer(window, level, groups > 1), schema), "packed")
        done.append(out.where("settled").drop("settled"))
        if groups == 1:
            return _all(done)
        rest = out.where("NOT settled").drop("settled", "sequence_id", "offset")
        groups, level = -(-groups // 64), level + 1


def _packer(window: int, level: int, again: bool):
    def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        group = group.drop_columns(["part"]).sort_by([("length", "ascending"), ("ids_crc32", "ascending"), ("start", "ascending")])
        lengths = group["length"].to_numpy()
        sequence, offset = windows_of(lengths, window)
        lost = np.array([padding(int(n), window) for n in np.bincount(sequence, weights=lengths)])
        unsettled = [n for n in np.argsort(-lost, kind="stable")[:2] if lost[n]] if again else []
        ids = (level << 56) + (key[0].as_py() << 24) + sequence
        for name, column in (("sequence_id", ids), ("offset", offset), ("settled", ~np.isin(sequence, unsettled))):
            group = group.append_column(name, pa.array(column))
        return group

    return pack


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@query("op10_packing")
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packed(table(spark, folder, "documents"), tokenizer_json())
