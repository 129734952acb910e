"""BPE encoding and decoding with a pair occurrence index over the distinct words of a partition.

The vocabulary file is read on the driver and broadcast: its size is fixed by the tokenizer, not by the data. Each task
splits its texts at white space into pieces, encodes the pieces it has not met yet with ``merge_words`` and keeps their
ids. Decoding looks up the token strings of a whole batch of ids at once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import require

#: Words, and pieces, whose ids a worker keeps, and their characters; beyond either the memory starts anew, which changes no result.
MAX_KEPT, MAX_KEPT_CHARS = 400_000, 8 << 20
#: Distinct new words that one run of the index takes.
INDEX_WORDS = 50_000
#: The combining marks and composing letters, as ranges of code points, that Unicode has had since version 10.
#: The tokenizers library composes (NFC) by the tables of version 9, to which these are letters that combine with nothing.
MARKS_SINCE_10 = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A "
    "11930-11938 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)

#: The letters and numbers that Unicode 16 added to 15.1, as ranges of code points. The library splits by the tables of version 16.
LETTERS_OF_16 = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 "
    "13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
)
NUMBERS_OF_16 = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Capital letters that Unicode 16 and 17 added, as ranges, and the first small letter of each range. The library lower-cases by version 17.
SMALL_LETTERS = "1C89:1C8A A7CB:0264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:019B 10D50-10D65:10D70 16EA0-16EB8:16EBB"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def default_vocabulary() -> str:
    """The file of the installed public word-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load_vocabulary(path: str) -> dict:
    """Ids of symbols, ranked merges, special tokens, split pattern and word end of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab = model["vocab"]
    end = model.get("end_of_word_suffix") or ""
    merges: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {"vocab": vocab, "merges": merges, "special": special, "split": split, "end": end}


def merge_words(words: list[list[int]], merges: dict[tuple[int, int], tuple[int, int]]) -> list[list[int]]:
    """Merge the symbols of all ``words`` at once by a pair occurrence index.

    ``places`` maps each pair to all positions where it starts. Pairs with a rank wait in a heap; the lowest rank is
    applied at all its positions from left to right, and the lists of the pairs that this makes are extended. Words
    are apart, so this is each word's own merge order. Positions that a merge has made stale are skipped when met.
    """
    symbol: list[int] = []
    for w in words:
        symbol += w
        symbol.append(-1)  # no pair crosses a word
    n = len(symbol)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i in range(n - 1):
        pair = (symbol[i], symbol[i + 1])
        if pair in merges:
            places.setdefault(pair, []).append(i)
    heap = [(merges[p][0], p) for p in places]
    heapq.heapify(heap)
    while heap:
        _, pair = heapq.heappop(heap)
        left, right = pair
        to = merges[pair][1]
        for i in sorted(places.pop(pair, ())):
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            k = after[j]
            symbol[i], symbol[j], after[i] = to, -2, k
            if k < n:
                before[k] = i
                new = (to, symbol[k])
                if new in merges:
                    if new not in places:
                        places[new] = []
                        heapq.heappush(heap, (merges[new][0], new))
                    places[new].append(i)
            h = before[i]
            if h >= 0:
                new = (symbol[h], to)
                if new in merges:
                    if new not in places:
                        places[new] = []
                        heapq.heappush(heap, (merges[new][0], new))
                    places[new].append(h)
    out: list[list[int]] = [[]]
    i = 0
    while i < n:
        if symbol[i] == -1:
            out.append([])
        else:
            out[-1].append(symbol[i])
        i = after[i]
    return out[:-1]


def code_points(ranges: str) -> list[int]:
    """The code points of ranges such as ``07FD 0898-089F``."""
    ends = [[int(c, 16) for c in r.split("-")] for r in ranges.split()]
    return [c for e in ends for c in range(e[0], e[-1] + 1)]


def newer_letters() -> str:
    """Ranges of code points that the regex module takes for letters or numbers and the tokenizers library doesn't.

    The library's tables are those of Unicode 16: what Python's tables (15.1 or 16) know and the letters and numbers of 16.
    """
    of_16 = {*code_points(LETTERS_OF_16), *code_points(NUMBERS_OF_16)}
    found = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x40000)]))) if unicodedata.category(c) == "Cn" and ord(c) not in of_16]
    ranges: list[list[int]] = []
    for c in found:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def small_letters() -> dict[int, int]:
    """Small letter by capital letter, for those that Python's tables may not know."""
    pairs = [r.split(":") for r in SMALL_LETTERS.split()]
    return {c: int(to, 16) + i for capitals, to in pairs for i, c in enumerate(code_points(capitals))}


def composed(text: str, marks=regex.compile("([" + "".join("-".join(f"\\U{int(c, 16):08x}" for c in r.split("-")) for r in MARKS_SINCE_10.split()) + "])")) -> str:
    """NFC as of Unicode 9."""
    if not marks.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(part if i % 2 else unicodedata.normalize("NFC", part) for i, part in enumerate(marks.split(text)))


class Codec:
    """Encodes and decodes texts; keeps the ids of pieces (texts between white space) that it has met."""

    def __init__(self, spec: dict):
        self.spec = spec
        vocab, end = spec["vocab"], spec["end"]
        chars = byte_symbols()
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + end] for c in chars]
        self.find = regex.compile(spec["split"]).findall
        young = newer_letters()
        self.young = regex.compile(f"[{young}]") if young else None
        self.find_old = regex.compile("(?V1)" + regex.sub(r"\\p\{([LN])\}", lambda m: f"[{m[0]}--[{young}]]", spec["split"])).findall if young else self.find
        self.special = regex.compile("(" + "|".join(map(regex.escape, spec["special"])) + ")") if spec["special"] else None
        self.small = small_letters()
        self.capital = regex.compile("[" + "".join(map(chr, self.small)) + "]")
        #: str.split() takes these for white space, the split pattern doesn't.
        self.separators = regex.compile("[\x1c-\x1f]")
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in spec["special"].items()}
        #: Token strings by id, each followed by the space that joins it to the next.
        self.names = pa.array([names.get(i, "") + " " for i in range(max(names) + 1)], pa.large_string())
        self.kept: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.kept_chars = self.known_chars = 0

    def pieces(self, text: str) -> list[str]:
        """Normalised pieces in order; no word of the split pattern crosses white space.

        Special tokens are looked for in the text as it is, before lower-casing. One stands as a space and its string,
        which no other piece begins with.
        """
        if self.special is not None and self.special.search(text):
            return [w for part in self.special.split(text) for w in ([" " + part] if part in self.spec["special"] else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        else:
            text = composed(text)
            # lower-casing is done character by character, without context
            text = text.lower() if "Σ" not in text else "".join("σ" if c == "Σ" else c.lower() for c in text)
            if self.capital.search(text):
                text = text.translate(self.small)
        return self.split(text) if self.separators.search(text) else text.split()

    def words(self, piece: str) -> list[str]:
        """The words of a piece; a special token is one."""
        return [piece] if piece[:1] == " " else self.split(piece)

    def split(self, text: str) -> list[str]:
        """The words that the split pattern finds in a normalised text."""
        if self.young is not None and not text.isascii() and self.young.search(text):
            return self.find_old(text)
        return self.find(text)

    def encode_pieces(self, pieces: list[str]) -> None:
        """Put the ids of pieces not met before into ``kept``; only words not met before are merged."""
        split = [self.words(p) for p in pieces]
        for token, i in self.spec["special"].items():
            self.known[" " + token] = np.array([i], dtype="<u4").tobytes()
        new = list({w: None for words in split for w in words if w not in self.known})
        for lo in range(0, len(new), INDEX_WORDS):
            part = new[lo : lo + INDEX_WORDS]
            symbols = []
            for w in part:
                b = w.encode()
                symbols.append([self.inner[x] for x in b[:-1]] + [self.last[b[-1]]])
            for w, ids in zip(part, merge_words(symbols, self.spec["merges"]), strict=True):
                self.known[w] = struct.pack(f"<{len(ids)}I", *ids)
                self.known_chars += len(w)
        get = self.known.__getitem__
        for p, words in zip(pieces, split, strict=True):
            self.kept[p] = b"".join(map(get, words))
            self.kept_chars += len(p)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; none for null or empty."""
        split = [self.pieces(t) if t else [] for t in texts]
        if len(self.kept) > MAX_KEPT or self.kept_chars > MAX_KEPT_CHARS:
            self.kept, self.kept_chars = {}, 0
        if len(self.known) > MAX_KEPT or self.known_chars > MAX_KEPT_CHARS:
            self.known, self.known_chars = {}, 0
        need: set[str] = set()
        for pieces in split:
            need.update(pieces)
        self.encode_pieces([p for p in need if p not in self.kept])
        get = self.kept.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode_batch(self, ids: list[bytes]) -> list[bytes]:
        """UTF-8 bytes of each text's token strings joined by one space, as the library does for a vocabulary without a decoder."""
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        if not len(flat):
            return [b""] * len(ids)
        found = self.names.take(pa.array(flat))
        ends = np.frombuffer(found.buffers()[1], dtype=np.int64)
        data = memoryview(found.buffers()[2])
        at = ends[np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])])].tolist()
        return [bytes(data[a : max(a, b - 1)]) for a, b in zip(at, at[1:], strict=False)]


_CODECS: dict[str, Codec] = {}


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Every document's columns but text, with ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``.

    The whole text is taken; a null or empty text has no ids and decodes to an empty string. Texts that hold a special
    token's string get its id, as the library does. Repeated rows come out as often as they are there. Columns named
    ids or decoded in the input are replaced.
    """
    require(documents, "text")
    path = path or default_vocabulary()
    spec = documents.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    columns = [c for c in documents.columns if c not in ("text", "ids", "decoded")]
    fields = documents.select(*columns).schema.add("ids", "binary").add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _CODECS.get(path) or _CODECS.setdefault(path, Codec(spec.value))
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = codec.encode_batch(part.column("text").to_pylist())
                decoded = [d.decode() for d in codec.decode_batch(ids)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [*columns, "ids", "decoded"])

    return documents.select(*columns, "text").mapInArrow(run, fields)


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``encode``; the texts stay in the task that made them."""
    require(documents, "doc_id", "text")
    path = path or default_vocabulary()
    spec = documents.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _CODECS.get(path) or _CODECS.setdefault(path, Codec(spec.value))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = codec.encode_batch(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([sha(i) for i in ids]), pa.array([sha(d) for d in codec.decode_batch(ids)])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of every whole text of documents."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
