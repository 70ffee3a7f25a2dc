"""BPE encoding by a segment tree over adjacent pair ranks, and decoding.

The leaves of the tree are the ranks of the pairs (symbol, next symbol) of one word; a node
holds the least (rank, place) below it, so the root is the leftmost lowest-rank merge. A merge
changes two leaves and removes one, each a logarithmic point update, until the root says that
no mergeable pair is left.

Texts are taken apart at white space first: no token crosses it. Each run of other characters
is encoded once per Python worker and kept in a table of bounded size.

Defined results: null text counts as empty, which has no ids and decodes to the empty string.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

NONE = 1 << 62
SHIFT = 20
#: Runs that a worker keeps encoded, in entries and in characters, and the longest of them; when full, the table starts anew.
KEEP, KEEP_CHARS, LONG = 500_000, 48 << 20, 256


def merge(symbols: list[int], ranks: dict[int, int], first: int) -> list[int]:
    """Merges the leftmost pair of lowest rank until no pair has a rank.

    ranks: of the pair a, b under a << SHIFT | b; the pair of rank r becomes the symbol first + r.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()  # leaves: pairs 0 .. n - 2; each holds rank * n + place
    get = ranks.get
    tree = [NONE] * (2 * size)
    a, i = symbols[0], size
    for b in symbols[1:]:
        r = get(a << SHIFT | b)
        if r is not None:
            tree[i] = r * n + i - size
        a = b
        i += 1
    for i in range(size - 1, 0, -1):
        x, y = tree[2 * i], tree[2 * i + 1]
        tree[i] = x if x < y else y
    if tree[1] == NONE:
        return symbols
    symbols = symbols[:]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while (root := tree[1]) != NONE:
        r, k = divmod(root, n)
        j = after[k]
        symbols[k] = new = first + r
        symbols[j] = -1
        after[k] = end = after[j]
        value = NONE
        if end < n:
            before[end] = k
            if (r := get(new << SHIFT | symbols[end])) is not None:
                value = r * n + k
        updates = [(size + k, value)]
        if j < n - 1:  # the pair that is gone
            updates.append((size + j, NONE))
        if (at := before[k]) >= 0:
            r = get(symbols[at] << SHIFT | new)
            updates.append((size + at, NONE if r is None else r * n + at))
        for i, value in updates:
            while tree[i] != value:
                tree[i] = value
                if i == 1:
                    break
                other = tree[i ^ 1]
                if other < value:
                    value = other
                i >>= 1
    return [x for x in symbols if x >= 0]


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies have it."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    stand_in = {b: chr(b) for b in keep}
    return [stand_in.get(b) or chr(next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizer file with an end-of-word suffix: NFC, lower case, white space dropped, byte-level words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {k: t for t, k in (self.vocab | self.special).items()}
        # Symbols: bytes, bytes that end a word, then the merged pairs in the order of their ranks.
        self.bytes = byte_symbols()
        self.text = [*self.bytes, *(b + self.end for b in self.bytes)]
        number = {t: k for k, t in enumerate(self.text)}
        self.ranks: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.ranks.setdefault(number[left] << SHIFT | number[right], r)
            number.setdefault(left + right, len(self.text))
            self.text.append(left + right)
        self.decimal = [str(self.vocab[t]) for t in self.text]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.seen: dict[str, tuple[str, str, int]] = {}
        self.held = 0

    def _word(self, word: str) -> list[int]:
        symbols = list(word.encode("utf-8"))
        symbols[-1] += 256
        return merge(symbols, self.ranks, 512)

    def _lower(self, run: str) -> str:
        return run.lower() if run.isascii() else "".join([c.lower() for c in unicodedata.normalize("NFC", run)])

    def _plain(self, run: str) -> list[int]:
        lower = self._lower(run)
        if lower.isalpha() and lower.isascii():
            return self._word(lower)
        return [t for w in self.words.findall(lower) for t in self._word(w)]

    def _strings(self, run: str) -> tuple[list[str], list[str]]:
        """Ids in decimal and tokens of a run of characters without white space."""
        if "<|" not in run:
            symbols = self._plain(run)
            return [self.decimal[s] for s in symbols], [self.text[s] for s in symbols]
        ids, tokens = [], []
        for part in self.cut.split(run):
            if part in self.special:
                ids.append(str(self.special[part]))
                tokens.append(part)
            elif part:
                symbols = self._plain(part)
                ids += [self.decimal[s] for s in symbols]
                tokens += [self.text[s] for s in symbols]
        return ids, tokens

    def runs(self, text: str) -> list[str]:
        if re.search("[\x1c-\x1f]", text):  # str.split() takes these for white space, the file's pattern doesn't
            return [r for r in regex.split(r"\s+", text) if r]
        return text.split()

    def lookup(self, run: str) -> tuple[str, str, int]:
        """Decimal ids joined by a space, tokens joined by a space, their number."""
        found = self.seen.get(run)
        if found is None:
            # Case and a final mark don't make a word new: its letters are looked up on their own.
            lower = self._lower(run)
            if lower[-1:] in (".", ",") and lower[:-1].isalpha():
                ids, tokens, n = self.lookup(lower[:-1])
                mark = ord(lower[-1]) + 256
                found = (f"{ids} {self.decimal[mark]}", f"{tokens} {self.text[mark]}", n + 1)
            elif lower != run and lower.isalpha():
                found = self.lookup(lower)
            else:
                ids, tokens = self._strings(run)
                found = (" ".join(ids), " ".join(tokens), len(ids))
            if len(run) <= LONG:
                if len(self.seen) >= KEEP or self.held > KEEP_CHARS:
                    self.seen.clear()
                    self.held = 0
                self.seen[run] = found
                self.held += len(run) + len(found[0]) + len(found[1])
        return found

    def encode(self, text: str) -> list[int]:
        return [int(k) for r in self.runs(text) for k in self._strings(r)[0]]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as the library does for a file that names no decoder."""
        return " ".join(self.tokens[k] for k in ids if k in self.tokens)

    def decode_text(self, ids: list[int]) -> str:
        """Words joined by a space, bytes back in place."""
        back = {c: b for b, c in enumerate(self.bytes)}
        joined = "".join(self.tokens[k] for k in ids if k in self.tokens)
        out = []
        for word in joined.split(self.end):
            out.append(bytes(back[c] for c in word if c in back).decode("utf-8", "replace"))
        return " ".join(out).strip()


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row; with_ids adds ids array<int> and decoded string.

    tokenizer: the file's path on every executor; None: the one that public_tokenizers installs there.
    """
    C.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches):
        bpe = load(tokenizer or default_path())
        lookup, sha = bpe.lookup, lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for b in batches:
            n, ids, decoded, more = [], [], [], ([], [])
            for text in b.column(1).to_pylist():
                found = [lookup(r) for r in bpe.runs(text or "")]
                a, t = " ".join([x[0] for x in found]), " ".join([x[1] for x in found])
                n.append(sum([x[2] for x in found]))
                ids.append(sha(a))
                decoded.append(sha(t))
                if with_ids:
                    more[0].append([int(x) for x in a.split()])
                    more[1].append(t)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                cols += [pa.array(more[0], pa.list_(pa.int32())), pa.array(more[1], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
