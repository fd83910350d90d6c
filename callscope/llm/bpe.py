"""BPE encoding with content-defined chunks that documents share, and decoding.

A gear hash over the last 16 characters cuts texts where its top bits are zero, so
a passage that documents share is cut alike wherever it stands.

1. Chunk hashes of all documents are counted; those that occur twice or more are set
   in a bit table of fixed size. What the table lets pass is "shared".
2. Each distinct shared chunk is encoded once for the whole corpus, on its own, into
   a dictionary (128-bit content hash, ids).
3. Documents without a shared chunk are encoded where they are read. The others become
   rows of references to chunks and of text between them; references are joined with
   the dictionary and a text's rows are brought together again, each distinct text once.
4. Where a chunk ends and something else begins, the ids beside the join are not to be
   trusted. They are decoded, encoded again together with what stands between, and the
   repair reaches outward by a word on either side until its outermost ids on both
   sides agree exactly with the chunks' own; from there on the chunks' ids are right.
   A chunk with too few words for that counts as text.

The bit table only decides what goes which way: a bit set by chance sends a chunk
through the dictionary that occurs once. At any size the ids are the library's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import bit_table, bounded, table, text_or_empty
from callscope.llm.wordpieces import BYTE_OF, encoder, load

CHUNK_BITS = 9
#: Chunks of fewer characters are not worth a reference.
LEAST_CHARS = 64
#: 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26
#: Distinct words and pieces of words that a worker holds encoded; later ones are encoded each time they come.
HELD_WORDS, HELD_PIECES = 150_000, 100_000
#: Hashes that a task holds to send a repeated chunk or text only once; more are sent again.
HELD = 1 << 17


def cuts(text: str, bits: int = CHUNK_BITS) -> list[int]:
    """Places after which the rolling hash cuts, without 0 and the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    h = codes * np.uint32(2654435769)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    for step in (1, 2, 4, 8):
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    at = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    return at[(at >= 16) & (at < len(codes))].tolist()


def _key(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def chunks(text: str) -> Iterator[tuple[str, bytes | None]]:
    """A text's chunks with their keys, None for those too short to share."""
    start = 0
    for end in [*cuts(text), len(text)]:
        chunk = text[start:end]
        start = end
        yield chunk, _key(chunk) if len(chunk) >= LEAST_CHARS else None


def _number(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


class _Shared:
    """The bit table in a worker."""

    def __init__(self, bits: bytes):
        self.bits = bits

    def has(self, key: bytes | None) -> bool:
        if key is None:
            return False
        at = _number(key) % FILTER_BITS
        return bool(self.bits[at >> 3] >> (at & 7) & 1)

    def parts(self, text: str) -> list[tuple[str, bytes | None]]:
        """The text in order as shared chunks with their keys and what lies between with None."""
        out: list[tuple[str, bytes | None]] = []
        for chunk, key in chunks(text):
            if self.has(key):
                out.append((chunk, key))
            elif out and out[-1][1] is None:
                out[-1] = (out[-1][0] + chunk, None)
            else:
                out.append((chunk, None))
        return out

    def any(self, text: str) -> bool:
        return len(text) >= LEAST_CHARS and any(self.has(key) for _, key in chunks(text))


def id_kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class _Disagreement(Exception):
    """No agreement inside a chunk: its text is encoded as a whole."""


class ChunkCodec:
    """A worker's encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        self.words = encoder(path, HELD_WORDS, HELD_PIECES)
        tokenizer = self.words.known.tokenizer
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        added = tokenizer.get_added_tokens_decoder()
        pieces = (tokenizer.id_to_token(i) for i in range(size))
        self.bytes_of = [added[i].content.encode() if i in added else bytes(BYTE_OF[c] for c in piece) for i, piece in enumerate(pieces)]
        self.kind = id_kind(size)
        self.begins = np.array([b[:1] in b" \t\n\x0b\x0c\r" and b != b"" for b in self.bytes_of])
        self.ends = np.array([b != b"" and 0x20 < b[-1] < 0x7F for b in self.bytes_of])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, equal to the library's."""
        return self.words.encode(text)

    def narrow(self, ids: bytes) -> bytes:
        """Ids as they are moved between tasks: two bytes each where the vocabulary allows it."""
        return np.frombuffer(ids, "<u4").astype(self.kind).tobytes()

    def widen(self, ids: bytes) -> bytes:
        return np.frombuffer(ids, self.kind).astype("<u4").tobytes()

    def _text(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode()

    def _words(self, ids: np.ndarray) -> np.ndarray:
        """Places between ids where a word ends in a visible ASCII character and white space follows."""
        return np.flatnonzero(self.begins[ids[1:]] & self.ends[ids[:-1]]) + 1

    def join(self, left, between: str, right) -> tuple[int, np.ndarray, int]:
        """Ids that replace everything from a place in ``left`` over ``between`` to a place in ``right``.

        ``left`` and ``right`` are (ids, word places), None at a text's ends. The
        window grows by one word a side until its first word has the ids that it has
        in ``left``, and its last word those that it has in ``right``.
        """
        reach_a = reach_b = 1
        while True:
            text, a, b = between, 0, 0
            if left:
                if reach_a >= len(left[1]):
                    raise _Disagreement
                a, inner = left[1][-1 - reach_a], left[1][-reach_a]
                text = self._text(left[0][a:]) + text
            if right:
                if reach_b >= len(right[1]):
                    raise _Disagreement
                outer, b = right[1][reach_b - 1], right[1][reach_b]
                text += self._text(right[0][:b])
            found = np.frombuffer(self.encode(text), "<u4")
            agreed_a = not left or np.array_equal(found[: inner - a], left[0][a:inner])
            agreed_b = not right or np.array_equal(found[len(found) - (b - outer) :], right[0][outer:b])
            if agreed_a and agreed_b:
                return a, found, b
            reach_a, reach_b = reach_a + (not agreed_a), reach_b + (not agreed_b)

    def assemble(self, parts: list[str | bytes]) -> bytes:
        """Texts and chunks' ids, in order -> the ids of the whole text."""
        try:
            out, between, left, used = [], "", None, 0
            for part in parts:
                if isinstance(part, str):
                    between += part
                    continue
                ids = np.frombuffer(part, "<u4")
                right = ids, self._words(ids)
                if len(right[1]) < 4:
                    between += self._text(ids)
                elif left is None and not between:
                    left = right
                else:
                    a, found, b = self.join(left, between, right)
                    out += [left[0][used:a], found] if left else [found]
                    between, left, used = "", right, b
            if left and between:
                a, found, _ = self.join(left, between, None)
                out += [left[0][used:a], found]
            elif left:
                out.append(left[0][used:])
            elif between:
                return self.encode(between)
            return b"".join(x.tobytes() for x in out)
        except _Disagreement:
            return self.encode("".join(p if isinstance(p, str) else self._text(np.frombuffer(p, "<u4")) for p in parts))

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8, special tokens included."""
        joined = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return joined.decode("utf-8", "replace").encode()


_codecs: dict[str, ChunkCodec] = {}


def codec(path: str) -> ChunkCodec:
    """The worker's codec of a file; a worker keeps it from task to task."""
    if path not in _codecs:
        _codecs[path] = ChunkCodec(path)
    return _codecs[path]


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_number(key) for text in batch["text"] for _, key in chunks(text.as_py()) if key]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["h"])


def _shared_chunks(bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, seen = _Shared(bits), set()
        for batch in batches:
            found = {}
            for text in batch["text"]:
                for chunk, key in chunks(text.as_py()):
                    if shared.has(key) and key not in seen:
                        found[key] = chunk
                        if len(seen) < HELD:
                            seen.add(key)
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.binary()), pa.array([*found.values()], pa.string())], names=["key", "chunk"])

    return run


def _encode_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = codec(path), None
        for batch in batches:
            keys, ids = [], []
            for key, chunk in zip(batch["key"].to_pylist(), batch["chunk"]):
                if key != last:
                    keys.append(key)
                    ids.append(coder.narrow(coder.encode(chunk.as_py())))
                last = key
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.binary())], names=["chunk_key", "ids"])

    return run


def _split(bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, seen = _Shared(bits), set()
        for batch in batches:
            out: list[tuple] = []
            for text in batch["text"]:
                text = text.as_py()
                parts = shared.parts(text)
                if not any(key for _, key in parts):
                    continue
                whole = _key(text)
                if whole in seen:
                    continue
                if len(seen) < HELD:
                    seen.add(whole)
                # A text's own parts get a key that no chunk has, so that they spread evenly over the join.
                out += [(whole, i, key or _key(f"{whole.hex()}:{i}"), None if key else part) for i, (part, key) in enumerate(parts)]
            columns = [*zip(*out)] or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int32(), pa.binary(), pa.string()))], names=["text_key", "place", "key", "own"])

    return run


def _assemble(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, whole, place, parts, done = codec(path), None, None, [], []
        for batch in batches:
            for key, at, ids, own in zip(batch["text_key"].to_pylist(), batch["place"].to_pylist(), batch["ids"], batch["own"]):
                if key != whole:
                    if whole is not None:
                        done.append((whole, coder.assemble(parts)))
                    whole, place, parts = key, None, []
                if at != place:  # equal texts of different tasks sent equal rows
                    parts.append(own.as_py() if own.is_valid else coder.widen(ids.as_py()))
                    place = at
            if done:
                yield _finished(coder, "text_key", [k for k, _ in done], pa.binary(), [x for _, x in done], True)
                done = []
        if whole is not None:
            yield _finished(coder, "text_key", [whole], pa.binary(), [coder.assemble(parts)], True)

    return run


def _finished(coder: ChunkCodec, name: str, keys, kind: pa.DataType, ids: list[bytes], narrow: bool = False) -> pa.RecordBatch:
    texts = [hashlib.sha256(coder.decode(x)).hexdigest() for x in ids]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, kind), pa.array([coder.narrow(x) for x in ids] if narrow else ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(texts, pa.string())],
        names=[name, "ids", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _marked(bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _Shared(bits)
        for batch in batches:
            keys = [_key(text) if shared.any(text := x.as_py()) else None for x in batch["text"]]
            kept = pa.array([k is not None for k in keys], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(keys, pa.binary())], names=["doc_id", "text_key"]).filter(kept)

    return run


def _direct(bits: bytes, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, coder = _Shared(bits), codec(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                texts = [x.as_py() for x in batch["text"][at : at + 256]]
                own = pa.array([not shared.any(x) for x in texts], pa.bool_())
                ids = [coder.encode(x) for x, alone in zip(texts, own.to_pylist()) if alone]
                yield _finished(coder, "doc_id", batch["doc_id"][at : at + 256].filter(own), batch["doc_id"].type, ids)

    return run


OUT = "ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) -> doc_id, ids binary, n_tokens, ids_sha256, decoded_sha256; a row for each row.

    ``ids`` are little-endian unsigned 32-bit integers. A null text is empty and
    has no ids; a null doc_id is carried; repeated rows give repeated rows; an
    empty table gives none; further columns are ignored. What moves: a hash a chunk,
    each shared chunk once, and of texts with shared chunks what is not shared.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    texts = rows.select("text")
    repeated = texts.transform(bounded).mapInArrow(_hashes, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    bits = bit_table(repeated, "h", FILTER_BITS)
    distinct = texts.transform(bounded).mapInArrow(_shared_chunks(bits), "key binary, chunk string").repartition("key").sortWithinPartitions("key")
    dictionary = distinct.transform(bounded).mapInArrow(_encode_chunks(tokenizer_path), "chunk_key binary, ids binary")
    parts = texts.transform(bounded).mapInArrow(_split(bits), "text_key binary, place int, key binary, own string")
    known = parts.join(dictionary, parts["key"] == dictionary["chunk_key"], "left").select("text_key", "place", "ids", "own")
    joined = known.repartition("text_key").sortWithinPartitions("text_key", "place").transform(bounded).mapInArrow(_assemble(tokenizer_path), f"text_key binary, {OUT}")
    marked = rows.transform(bounded).mapInArrow(_marked(bits), f"doc_id {kind}, text_key binary")
    # Ids went through the shuffles narrow; written out to four bytes only if somebody reads them.
    ids = F.unhex(F.regexp_replace(F.hex("ids"), "(....)", "$10000")) if id_kind(load(tokenizer_path).get_vocab_size(with_added_tokens=True)) == "<u2" else F.col("ids")
    shared = marked.join(joined, "text_key").select("doc_id", ids.alias("ids"), "n_tokens", "ids_sha256", "decoded_sha256")
    return rows.transform(bounded).mapInArrow(_direct(bits, tokenizer_path), f"doc_id {kind}, {OUT}").unionByName(shared)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: ids and decoded text of every document, as digests."""
    from callscope.llm.tokens import default_tokenizer

    return encode_documents(table(spark, sf_dir, "documents"), default_tokenizer()).drop("ids")
