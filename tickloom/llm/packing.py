"""Hierarchical multi-length packing of token streams.

A document is its token ids with the end id; whole windows of the largest context size are cut off
it, the rest is routed to the smallest tier (256, 512, 1,024, 2,048) that holds it. Tiers are packed
from the longest down: a window opens with the longest document of its tier, its gap is filled from
the shorter tiers, largest fitting document first, and the last gap is closed by cutting one shorter
document. So every window is exactly full. What a scan partition has left over at its end is cut into
windows of powers of two, which need no padding either. Windows of a flush are dealt to step groups in
snake order of their attention cost (sum of squared piece lengths), so groups of one tier carry equal
tokens and near-equal cost.

Packing runs inside the scan's partitions on Arrow batches: no shuffle, and the memory held is one
batch, the ids of a slice of ``SLICE_BYTES`` (or of one longer text) and up to ``FLUSH_PIECES`` waiting pieces. Sequence ids are (partition, number), so a lost task is redone
with the same ids.

Token ids come from the public vocabulary. Texts are cut at places that no pre-token spans, equal
pieces are found by Arrow, and the tokenizer is asked once for each piece of a slice of texts.

Defined results: null text is empty (one end id); very long texts take as many windows as they need; rows repeated
with one doc_id are documents of their own; a null doc_id stays null; an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F

from .common import released, slices, table, text_of

TIERS = (2048, 1024, 512, 256)
END_ID = 1
CACHE_BYTES = 32 << 20
ENTRY_BYTES = 200  # of a kept piece with its ids, about
SLICE_BYTES = 3 << 20
FLUSH_PIECES = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, sequence_length long, step_group long"
#: A blank before a non-blank starts a pre-token whatever stands before it, so texts may be cut there.
CUT = re.compile(r"(?= \S)")
#: Pieces that begin so (or are empty) stand next to more white space; their texts are cut one by one.
SPACED = r"^(?:$|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])"
#: Signs that end a word; after a letter or digit they are a pre-token of their own.
SIGNS = ".,;:!?&*$#%)"
LONG_PIECE = 64


class Encoder:
    """Text to ids as a uint32 array; of a slice of texts, equal pieces are encoded once.

    Texts are cut before every blank that a non-blank follows and around every newline between
    non-blanks, and signs at the end of a word are cut off; no pre-token spans these places. Ids are
    kept in two generations of half ``CACHE_BYTES``: what is met again moves to the young one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = {s: self.tokenizer.encode(s, add_special_tokens=False).ids for s in special}
        self.marks = re.compile("|".join(map(re.escape, special))) if special else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for k in range(0, len(pieces), 20_000):
            part = pieces[k : k + 20_000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                out[p] = array("I", e.ids).tobytes()
        return out

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        young, old = self.young, self.old
        fresh = self.learn([p for p in pieces if p not in young and p not in old])
        out = []
        for p in pieces:
            if (i := young.get(p)) is None:
                i = old.get(p) or fresh[p]
                if len(p) <= LONG_PIECE:
                    young[p] = i
                    self.held += ENTRY_BYTES
            out.append(i)
        if self.held > CACHE_BYTES // 2:
            self.young, self.old, self.held = {}, self.young, 0
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, with the end id; the vocabulary's special tokens in a text have their own ids."""
        if not any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special):
            return self.plain(texts)
        out = []
        for text in texts.to_pylist():
            between = self.plain(pa.array(self.marks.split(text), pa.string()))
            ids = [between[0][:-1]]
            for mark, part in zip(self.marks.findall(text), between[1:], strict=True):
                ids += [np.array(self.special[mark], np.uint32), part[:-1]]
            out.append(np.concatenate([*ids, np.array([END_ID], np.uint32)]))
        return out

    def plain(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of texts that hold no special token."""
        lines = pc.split_pattern(texts, "\n")
        words = pc.split_pattern(lines.values, " ")
        encoded = words.values.dictionary_encode()
        names, number = encoded.dictionary, encoded.indices.to_numpy()
        line_at, word_at = lines.offsets.to_numpy(), words.offsets.to_numpy()
        odd = np.zeros(len(texts), bool)
        spaced = pc.match_substring_regex(names, SPACED).to_numpy(zero_copy_only=False)[number]
        if spaced.any():
            owner = np.searchsorted(word_at[line_at[1:]], np.flatnonzero(spaced), side="right")
            odd[owner] = True
            odd[pc.equal(texts, "").to_numpy(zero_copy_only=False)] = False
        # The first word of a line has no blank before it: entries of their own.
        first = np.zeros(len(number), bool)
        first[word_at[:-1]] = True
        heads, head_number = np.unique(number[first], return_inverse=True)
        entry = number.copy()
        entry[first] = len(names) + head_number
        pieces = pa.concat_arrays([pc.binary_join_element_wise("", names, " "), names.take(pa.array(heads))])
        used = np.zeros(len(pieces), bool)
        used[entry] = True
        entry = (np.cumsum(used, dtype=np.int32) - 1)[entry]
        head, tail, ids = self.of_entries(pieces.filter(pa.array(used)))
        newline, end = len(head), len(head) + 1
        head = np.append(head, [len(ids), len(ids) + 1]).astype(np.int32)
        tail = np.append(tail, [-1, -1]).astype(np.int32)
        ids += [*self.ids_of(["\n"]), array("I", [END_ID]).tobytes()]
        # Entries in order: a newline before every line but a text's first, an end after every text.
        more = np.delete(np.arange(len(words)), line_at[:-1])
        places = np.concatenate([word_at[more], word_at[line_at[1:]]])
        row = np.insert(entry, places, np.repeat(np.array([newline, end], np.int32), [len(more), len(texts)]))
        sizes = np.array([len(i) // 4 for i in ids] + [0], np.int32)  # the last one is no piece
        flat = np.frombuffer(b"".join(ids), np.uint32)
        begin = np.cumsum(sizes, dtype=np.int32) - sizes
        parts = np.stack([head[row], tail[row]], 1).ravel()
        n = sizes[parts]
        stop = np.cumsum(n, dtype=np.int32)
        place = np.repeat(begin[parts] - stop + n, n)
        place += np.arange(len(place), dtype=np.int32)
        tokens = flat[place]
        per_text = np.diff(word_at[line_at]) + np.diff(line_at)  # words, newlines, end
        last = np.cumsum(per_text) - 1
        out = np.split(tokens, stop[1::2][last][:-1]) if len(texts) else []
        for k in np.flatnonzero(odd):
            out[k] = self.alone(texts[k].as_py())
        return out

    def of_entries(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of distinct pieces the number of the word and of its closing signs (or -1), and the ids of both."""
        words = pc.utf8_rtrim(pieces, characters=SIGNS)
        cut = pc.and_(pc.match_substring_regex(words, r"[\pL\pN]$"), pc.less(pc.binary_length(words), pc.binary_length(pieces)))
        words = pc.if_else(cut, words, pieces).dictionary_encode()
        signs = pc.extract_regex(pieces.filter(cut), f"(?P<s>[{re.escape(SIGNS)}]+)$").field(0).dictionary_encode()
        tail = np.full(len(pieces), -1)
        tail[cut.to_numpy(zero_copy_only=False)] = signs.indices.to_numpy() + len(words.dictionary)
        return words.indices.to_numpy(), tail, self.ids_of(words.dictionary.to_pylist()) + self.ids_of(signs.dictionary.to_pylist())

    def alone(self, text: str) -> np.ndarray:
        """A text with white space next to white space."""
        parts = [p for p in CUT.split(text) if p]
        distinct = list(dict.fromkeys(parts))
        ids = dict(zip(distinct, self.ids_of(distinct), strict=True))
        return np.frombuffer(b"".join(ids[p] for p in parts) + array("I", [END_ID]).tobytes(), np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder a Python worker, so that its tasks load the vocabulary once and share what is kept."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Packs the documents of one partition; ``flush`` returns finished pieces."""

    def __init__(self, partition: int, tiers=TIERS, group_tokens: int = 8 * 2048):
        self.tiers, self.group_tokens = tuple(tiers), group_tokens
        self.top = self.tiers[0]
        self.next = partition << 36
        self.group = partition << 36
        self.waiting: dict[int, list] = {t: [] for t in self.tiers}  # (length, number, piece), sorted
        self.held = dict.fromkeys(self.tiers, 0)  # tokens waiting
        self.number = 0
        self.windows: list[tuple[int, list]] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.top:
            self.windows.append((self.top, [(doc_id, at, ids[at : at + self.top], n)]))
            at += self.top
        if at < n:
            self.route((doc_id, at, ids[at:], n))

    def route(self, piece) -> None:
        size = len(piece[2])
        tier = next(t for t in reversed(self.tiers) if t >= size)
        self.number += 1
        self.held[tier] += size
        insort(self.waiting[tier], (size, self.number, piece))

    def take(self, tier: int, k: int):
        size, _, piece = self.waiting[tier].pop(k)
        self.held[tier] -= size
        return piece

    def fitting(self, gap: int, tier: int):
        """The longest waiting piece of the shorter tiers that fits; else the shortest one, cut.

        The last tier is filled from itself, and so is a tier whose shorter ones are used up.
        """
        shorter = [t for t in self.tiers if t < tier] or [tier]
        for t in shorter:
            if self.waiting[t] and self.waiting[t][0][0] <= gap:
                return self.take(t, bisect_right(self.waiting[t], gap, key=lambda x: x[0]) - 1)
        t = next(t for t in [*reversed(shorter), tier] if self.waiting[t])
        doc_id, start, ids, n = self.take(t, 0)
        if len(ids) <= gap:
            return doc_id, start, ids, n
        self.route((doc_id, start + gap, ids[gap:], n))
        return doc_id, start, ids[:gap], n

    def pack(self, last: bool = False) -> None:
        for tier in self.tiers:
            while self.waiting[tier] and sum(self.held[t] for t in self.tiers if t <= tier) >= tier:
                parts = [self.take(tier, -1)]
                gap = tier - len(parts[0][2])
                while gap:
                    parts.append(self.fitting(gap, tier))
                    gap -= len(parts[-1][2])
                self.windows.append((tier, parts))
        if last:
            self.rest([x[2] for t in self.tiers for x in reversed(self.waiting[t])])
            self.waiting = {t: [] for t in self.tiers}
            self.held = dict.fromkeys(self.tiers, 0)

    def rest(self, pieces: list) -> None:
        """Cuts what is left into windows of powers of two, the largest first."""
        left = sum(len(p[2]) for p in pieces)
        while left:
            size = min(self.top, 1 << (left.bit_length() - 1))
            left -= size
            parts, gap = [], size
            while gap:
                doc_id, start, ids, n = pieces.pop(0)
                if len(ids) > gap:
                    pieces.insert(0, (doc_id, start + gap, ids[gap:], n))
                parts.append((doc_id, start, ids[:gap], n))
                gap -= len(parts[-1][2])
            self.windows.append((size, parts))

    def flush(self) -> list[tuple]:
        rows = []
        for tier in sorted({t for t, _ in self.windows}, reverse=True):
            own = [w for t, w in self.windows if t == tier]
            cost = [sum(len(p[2]) ** 2 for p in w) for w in own]
            groups = max(1, -(-len(own) * tier // self.group_tokens))
            for k, i in enumerate(sorted(range(len(own)), key=lambda i: (-cost[i], i))):
                turn, place = divmod(k, groups)
                group = self.group + (place if turn % 2 == 0 else groups - 1 - place)
                offset = 0
                for doc_id, start, ids, n in own[i]:
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, self.next, offset, tier if tier in self.tiers else 0, tier, group))
                    offset += len(ids)
                self.next += 1
            self.group += groups
        self.windows = []
        return rows


def _packed(path: str, tiers, group_tokens: int):
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in "start length ids_crc32 doc_tokens sequence_id offset".split()), ("tier", pa.int32()), ("sequence_length", pa.int64()), ("step_group", pa.int64())])

    def batch(rows):
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        encoder, packer = encoder_of(path), Packer(TaskContext.get().partitionId(), tiers, group_tokens)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for k, end in slices(texts, 1 << 20, SLICE_BYTES):
                for doc_id, tokens in zip(ids[k:end], encoder.encode(texts[k:end]), strict=True):
                    packer.add(doc_id, tokens)
                if sum(map(len, packer.waiting.values())) >= FLUSH_PIECES:
                    packer.pack()
                yield batch(packer.flush())
        packer.pack(last=True)
        yield batch(packer.flush())

    return run


def pack_documents(docs, vocabulary: str, tiers=TIERS, group_tokens: int = 8 * 2048):
    """One row per piece; see the module's text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(released(_packed(vocabulary, tiers, group_tokens)), PIECES)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op5_packing": op5_packing}
