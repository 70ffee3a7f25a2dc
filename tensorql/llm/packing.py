"""Bounded-space online packing of token sequences.

Each task streams over its documents with a fixed number of open windows. Whole windows of
a long document are emitted at once; the rest goes into the open window that it fits best.
When it fits none and all are open, the fullest is emitted. Windows still open at the end of
a task are the leftovers; those of some tasks at a time are merged, their pieces placed
anew, best fit in falling order of length. What a merge holds is bounded by the number of
tasks it takes times the open windows, whatever the size of the input.

Defined results: null text counts as empty, which is the end id alone. Repeated rows are
packed like any other. Ties go to the window opened first.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .bpe import byte_symbols

WINDOW = 2048
OPEN = 128
#: Tasks whose leftovers are merged together.
FAN_IN = 16
END_ID = 1
#: Runs that a worker keeps encoded, in entries and in bytes of runs and ids; when full, the table starts anew.
KEEP, KEEP_BYTES = 300_000, 24 << 20
#: Texts with a longer run are encoded whole, and nothing of them is kept.
LONG = 512
#: How the file splits texts before its merges: the pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sequence ids of merged windows have this bit.
MERGED = 1 << 61


class ByteBpe:
    """Ids of a byte-level tokenizer file as the tokenizers library gives them, as little-endian 32-bit bytes.

    The file's pattern never joins a character that isn't white space with the white space
    after it, so a text may be cut before each single space between two such characters.
    What lies between cuts is encoded once and kept. Latin runs that are new go through
    tiktoken, many in one string, with the ranks of the same file (where its merges are in the
    order of its ids); all others go through the tokenizers library one by one.
    """

    #: White space other than a space or a line feed, or what some version of a pattern may take for it.
    ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
    ODD_ASCII = re.compile("[\t\x0b\x0c\r\x1c-\x1f]")
    LATIN = "\u0250"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        vocab = {bytes(byte_of[c] for c in t): k for t, k in spec["model"]["vocab"].items() if t not in self.special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        in_order = all(spec["model"]["vocab"][t] == 256 + k for k, t in enumerate(merged)) and len(vocab) == 256 + len(merged)
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={}) if in_order else None
        if not self._as_supposed(spec):
            self.fast, self._plain = None, lambda text: False
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for t, k in vocab.items():
            self.width[k] = len(t)
        self.seen: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _as_supposed(spec: dict) -> bool:
        """The file splits and merges as cutting and tiktoken suppose; texts of another file go through the library whole."""
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        return (
            spec.get("normalizer") is None
            and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
            and (model.get("type", "BPE"), bool(model.get("dropout")), bool(model.get("ignore_merges"))) == ("BPE", False, False)
            and not model.get("continuing_subword_prefix")
            and not model.get("end_of_word_suffix")
        )

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bool:
        """Cut safely at every space."""
        if not text or text[0] == " " or text[-1] == " " or "  " in text or "\n " in text or " \n" in text:
            return False
        return text.isascii() and not self.ODD_ASCII.search(text) or not self.ODD.search(text)

    def _learn(self, new: list[str]) -> None:
        """Encodes runs, each of which begins with a space."""
        seen, plain = self.seen, []
        for r in new:
            if self.fast and max(r) < self.LATIN and r[-1] != "\n" and not ("<|" in r and any(s in r for s in self.special)):
                plain.append(r)
            else:
                seen[r] = self._encode(" " + r)
        if plain:
            ids = self.fast.encode_to_numpy(" " + " ".join(plain))
            ends = np.cumsum(self.width[ids])
            sizes = np.fromiter((len(r.encode("utf-8")) + 1 for r in plain), np.int64, len(plain))
            cuts = np.searchsorted(ends, np.cumsum(sizes)) + 1
            data, at = ids.astype("<u4").tobytes(), 0
            for r, cut in zip(plain, (4 * cuts).tolist(), strict=True):
                seen[r] = data[at:cut]
                at = cut

    def __call__(self, texts: list[str]) -> list[bytes]:
        seen = self.seen
        if len(seen) > KEEP or self.held > KEEP_BYTES:
            seen.clear()
            self.held = 0
        split = [t.split(" ") if self._plain(t) else None for t in texts]
        split = [runs if runs and max(map(len, runs)) <= LONG else None for runs in split]
        rest: set[str] = set()
        for runs in split:
            if runs:
                rest.update(runs[1:])
        if new := [r for r in rest if r not in seen]:
            self._learn(new)
            self.held += sum(len(r) + len(seen[r]) for r in new)
        out = []
        for text, runs in zip(texts, split, strict=True):
            if runs is None:
                out.append(self._encode(text) if text else b"")
            else:
                out.append(self._encode(runs[0]) + b"".join([seen[r] for r in runs[1:]]))
        return out


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Windows:
    """At most `most` open windows (no bound: 0). add() returns what it closes."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.n = size, most, 0
        self.free: list[tuple[int, int]] = []  # (free, number of the window), sorted
        self.held: dict[int, list] = {}

    def add(self, length: int, piece) -> list[list]:
        """Places a piece of up to `size` ids; piece(offset) is what a window keeps of it."""
        at, closed = bisect_left(self.free, (length, -1)), []
        if at < len(self.free):
            free, k = self.free.pop(at)
        else:
            if self.most and len(self.free) >= self.most:
                closed.append(self.held.pop(self.free.pop(0)[1]))
            free, k, self.n = self.size, self.n, self.n + 1
            self.held[k] = []
        self.held[k].append(piece(self.size - free))
        if free == length:
            closed.append(self.held.pop(k))
        else:
            insort(self.free, (free - length, k))
        return closed


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_task(size: int, most: int, path: str | None, with_ids: bool):
    def run(batches):
        encode = load(path or default_path())

        def encoded(texts, most=1_000_000):
            """In groups of about so many characters."""
            part, size = [], 0
            for t in texts:
                part.append(t or "")
                size += len(part[-1])
                if size >= most:
                    yield from (ids + end for ids in encode(part))
                    part, size = [], 0
            yield from (ids + end for ids in encode(part))

        end, task = END_ID.to_bytes(4, "little"), TaskContext.get().partitionId()
        windows, n, out = Windows(size, most), 0, []

        def emit(pieces, closed):
            nonlocal n
            for p in pieces:
                out.append((*p[:5], (task << 33) + n, p[5], closed, task, *p[6:]))
            n += 1

        def flush(kind):
            cols = list(zip(*out, strict=True)) or [()] * (9 + with_ids)
            kinds = [kind, *[pa.int64()] * 6, pa.bool_(), pa.int64(), pa.list_(pa.int32())]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], [str(i) for i in range(len(cols))])

        kind = pa.int64()
        for b in batches:
            kind = b.column(0).type
            for doc, ids in zip(b.column(0).to_pylist(), encoded(b.column(1).to_pylist()), strict=True):
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    length = len(part) // 4
                    row = (doc, start, length, zlib.crc32(part), total)
                    own = (memoryview(part).cast("I").tolist(),) if with_ids else ()
                    if length == size:
                        emit([(*row, 0, *own)], True)
                        continue
                    for w in windows.add(length, lambda offset, row=row, own=own: (*row, offset, *own)):
                        emit(w, True)
                if len(out) > 20_000:
                    yield flush(kind)
        for k in sorted(windows.held):
            emit(windows.held[k], False)
        yield flush(kind)

    return run


def _merge(size: int):
    def run(key, table):
        order = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        windows, place, n = Windows(size, 0), [None] * len(order), 0
        closed = []
        for i, length in enumerate(order.column("length").to_pylist()):
            closed += windows.add(length, lambda offset, i=i: (i, offset))
        for w in [*closed, *(windows.held[k] for k in sorted(windows.held))]:
            for i, offset in w:
                place[i] = (MERGED + (key[0].as_py() << 33) + n, offset)
            n += 1
        at = {"sequence_id": 0, "offset": 1}
        return pa.table({c: pa.array([p[at[c]] for p in place], pa.int64()) if c in at else order.column(c) for c in order.column_names})

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, most: int = OPEN, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset); with_ids adds the ids of each piece.

    A sequence's pieces lie from offset 0 without gaps and hold up to size ids together.
    tokenizer: the file's path on every executor; None: the one that public_tokenizers installs there.
    """
    spark = docs.sparkSession
    C.ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    row = f"doc_id {kind}, {COLUMNS}"
    more = ", ids array<int>" * with_ids
    first = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        _pack_task(size, most, tokenizer, with_ids), f"{row}, closed boolean, task long{more}"
    )
    first, _ = C.materialize(first, "pieces")
    names = [c for c in first.columns if c not in ("closed", "task")]
    left = first.where("not closed").withColumn("group", F.expr(f"task div {FAN_IN}"))
    merged = left.select("group", *names).groupBy("group").applyInArrow(
        lambda key, table: _merge(size)(key, table.drop_columns(["group"])), row + more
    )
    return first.where("closed").select(*names).unionByName(merged.select(*names))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
