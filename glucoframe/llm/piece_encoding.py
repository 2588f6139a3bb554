"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it stands for."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucoframe.llm.common import small_batches, strings

SPACE = "▁"
# Characters after which a stretch of words handed to the library ends with the next word.
STRETCH = 2_000
_LABELS = np.arange(256, dtype=np.uint32)
_NORMAL, _USER, _UNUSED, _BYTE = 1, 4, 5, 6  # fixed values: kinds of pieces in a model file


def character_map(compiled: bytes) -> dict[str, str]:
    """The rules of a compiled character map: source string -> normalised string.

    The file holds the size of a double-array trie, its 32-bit units and the results as strings that end with a zero
    byte. A unit has its label in bits 0-7 (and 31), a leaf mark in bit 8, and the offset to its children in bits 10-30, times 256
    if bit 9 is set; a leaf holds the place of its result. All nodes of one depth are expanded at once.
    """
    if not compiled:
        return {}
    size = int(np.frombuffer(compiled, "<u4", 1)[0])
    units = np.frombuffer(compiled, "<u4", size // 4, 4)
    results = compiled[4 + size :]

    def children(places: np.ndarray) -> np.ndarray:
        unit = units[places]
        return places ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    rules: dict[str, str] = {}
    level = [(b"", int(base)) for base in children(np.zeros(1, np.uint32))]
    while level:
        bases = np.array([base for _, base in level], np.uint32)
        reached = bases[:, None] ^ _LABELS[None, 1:]
        inside = reached < len(units)
        found = inside & ((units[np.where(inside, reached, 0)] & 0x800000FF) == _LABELS[None, 1:])
        rows, labels = np.nonzero(found)
        places = reached[rows, labels]
        after, leaf = children(places), (units[places] >> 8) & 1
        following = []
        for row, label, base, is_leaf in zip(rows.tolist(), (labels + 1).tolist(), after.tolist(), leaf.tolist()):
            source = level[row][0] + bytes([label])
            if is_leaf:
                at = int(units[base]) & 0x7FFFFFFF
                rules[source.decode()] = results[at : results.index(b"\0", at)].decode()
            following.append((source, base))
        level = following
    return rules


class Normalizer:
    """Longest-prefix replacement by the rules of a character map, then the treatment of spaces a model asks for."""

    def __init__(self, rules: dict[str, str], dummy_prefix: bool = True, squeeze_spaces: bool = True, escape_spaces: bool = True):
        self._rules, self._dummy, self._squeeze, self._escape = rules, dummy_prefix, squeeze_spaces, escape_spaces
        sizes = defaultdict(set)
        for source in rules:
            sizes[source[0]].add(len(source))
        self._sizes = {first: sorted(found, reverse=True) for first, found in sizes.items()}
        self._first = re.compile("[" + "".join(map(re.escape, sizes)) + "]") if sizes else None

    def _replaced(self, text: str) -> tuple[str, np.ndarray]:
        """The text after all replacements, and for each of its bytes the byte of the original where its source begins."""
        raw = text.encode()
        whole = np.frombuffer(raw, np.uint8)
        own = np.arange(len(raw), dtype=np.int32)
        own = np.maximum.accumulate(np.where((whole & 0xC0) != 0x80, own, 0)).astype(np.int32) if len(raw) else own
        if self._first is None:
            return text, own
        parts, places, at, byte = [], [], 0, 0
        found = self._first.search(text)
        while found:
            start = found.start()
            for size in self._sizes[text[start]]:
                source = text[start : start + size]
                if source in self._rules:
                    break
            else:
                found = self._first.search(text, start + 1)
                continue
            target = self._rules[source]
            kept = len(text[at:start].encode())
            parts += (text[at:start], target)
            places += (own[byte : byte + kept], np.full(len(target.encode()), byte + kept, np.int32))
            at, byte = start + size, byte + kept + len(source.encode())
            found = self._first.search(text, at)
        return "".join([*parts, text[at:]]), np.concatenate([*places, own[byte:]])

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text with its spaces unescaped, and for each byte of its escaped form the first original byte of its
        source, then the end of the last. Escaping puts a three-byte mark in place of a space."""
        end = len(text.encode())
        made, places = self._replaced(text)
        if self._squeeze and made:
            data = np.frombuffer(made.encode(), np.uint8)
            space = data == 32
            keep = np.ones(len(data), bool)
            keep[0] = not space[0]
            keep[1:] = ~(space[1:] & space[:-1])
            last = len(data.tobytes().rstrip(b" "))
            if last < len(data):
                end = int(places[last])
            keep[last:] = False
            made, places = data[keep].tobytes().decode(), places[keep]
        if not made:
            return "", np.zeros(1, np.int32)
        if self._dummy:
            first = int(places[0]) if self._squeeze else 0
            made, places = " " + made, np.concatenate([np.array([first], np.int32), places])
        if self._escape:
            data = np.frombuffer(made.encode(), np.uint8)
            places = np.repeat(places, np.where(data == 32, 3, 1))
        return made, np.append(places, np.int32(end))


class Encoder:
    """A model file read once per worker: our normaliser before the library's segmentation of short stretches of words.

    Segmentation never joins two words where no piece runs from another character into a space mark, so a text may be cut
    there and the library's tables stay small for any text. In a vocabulary with such a piece the whole text is one stretch.
    """

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        kinds = {piece.type for piece in proto.pieces}
        if _USER in kinds or not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with byte fallback, without user-defined pieces and with spaces before words are supported")
        self.normalize = Normalizer(character_map(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        marks = f"[{SPACE} ]" if spec.escape_whitespaces else f"[{SPACE}]"
        self._border = re.compile(f"(?<!{marks})(?={marks})")
        self._crossing = any(self._border.search(piece.piece, 1) for piece in proto.pieces if piece.type in (_NORMAL, _UNUSED))
        self._simple = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        self._dummy = spec.add_dummy_prefix
        self._bytes = np.array([1 if piece.type == _BYTE else len(piece.piece.encode()) for piece in proto.pieces], np.int32)
        self._short = np.array([1 if piece.type == _BYTE else len(piece.piece.replace(SPACE, " ").encode()) for piece in proto.pieces], np.int32)
        self._spelled = np.array([piece.type == _BYTE and int(piece.piece[1:-1], 16) >= 0x80 for piece in proto.pieces], bool)
        self._whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.begin, self.end = self._whole.bos_id(), self._whole.eos_id()
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self._plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def _stretches(self, normal: str) -> list[str]:
        if self._crossing:
            return [normal]
        found, at = [], 0
        while at < len(normal):
            border = self._border.search(normal, at + STRETCH)
            end = border.start() if border else len(normal)
            found.append(normal[at:end])
            at = end
        return found

    def _ids(self, normal: str) -> np.ndarray:
        ids = self._plain.encode(self._stretches(normal), num_threads=1)
        return np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids)))

    def _aligned(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._simple and text and SPACE not in text:  # the map changes nothing and every mark is a space: bytes stay in step
            dummy = int(self._dummy)
            ids = self._ids(" " + text if dummy else text)
            stops = np.cumsum(self._short[ids], dtype=np.int64) - dummy
            starts = np.maximum(stops - self._short[ids], 0)
            raw = np.frombuffer(text.encode(), np.uint8)
            self._check(stops, len(raw))
            parts = np.flatnonzero(self._spelled[ids])  # single bytes of a character
            for _ in range(3):
                starts[parts] -= (raw[starts[parts]] & 0xC0) == 0x80
            inner = parts[stops[parts] < len(raw)]
            inner = inner[(raw[stops[inner]] & 0xC0) == 0x80]
            stops[inner] = starts[inner]
            return ids, starts, stops
        normal, places = self.normalize(text)
        ids = self._ids(normal)
        stops = np.cumsum(self._bytes[ids], dtype=np.int64)
        self._check(stops, len(places) - 1)
        return ids, places[stops - self._bytes[ids]], places[stops]

    @staticmethod
    def _check(stops: np.ndarray, size: int) -> None:
        if (int(stops[-1]) if len(stops) else 0) != size:
            raise ValueError("pieces do not cover the normalised text")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids with the model's begin and end ids, and the first and last byte (exclusive) of each piece in the text.

        Of a character spelled as bytes the last piece holds its span, the others are empty at its start. The begin and end
        ids are empty at the text's ends.
        """
        ids, starts, ends = self._aligned(text)
        size = len(text.encode())
        return (
            np.concatenate([[self.begin], ids, [self.end]]).astype("<u4"),
            np.concatenate([[0], starts, [size]]).astype("<u4"),
            np.concatenate([[0], ends, [size]]).astype("<u4"),
        )

    def decode(self, ids: list[int]) -> str:
        return self._whole.decode(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as model:
        return Encoder(model.read())


def encoded(text: Column, model_path: str) -> Column:
    """Struct of ids, starts and ends, each as unsigned 32-bit numbers, little end first; null text counts as empty."""

    @F.arrow_udf("struct<ids:binary,starts:binary,ends:binary>")
    def made(values: pa.Array) -> pa.Array:
        use = encoder(model_path)
        rows = [[], [], []]
        for text in strings(values):
            for column, numbers in zip(rows, use.encode(text)):
                column.append(numbers.tobytes())
        return pa.StructArray.from_arrays([pa.array(column, pa.binary()) for column in rows], names=["ids", "starts", "ends"])

    return made(text)


def decoded(ids: Column, model_path: str) -> Column:
    """The text the library decodes from ids in the form of `encoded`."""

    @F.arrow_udf("string")
    def made(values: pa.Array) -> pa.Array:
        use = encoder(model_path)
        return pa.array([use.decode(np.frombuffer(ids or b"", "<u4").tolist()) for ids in _each(values)], pa.string())

    return made(ids)


def _each(values: pa.Array, step: int = 256) -> Iterator[bytes | None]:
    for at in range(0, len(values), step):
        yield from values.slice(at, step).to_pylist()


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, starts, ends (see `encoded`).

    The compiled character map replaces the longest prefix at every place and records where each normalised byte comes
    from; every piece is carried back to bytes of the original text. Texts are encoded whole, one at a time, with four
    bytes of alignment per byte; no shuffle. Null or empty text: only the begin and end ids. Null or repeated ids: every
    row is a document. Further columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), encoded(F.col(f"`{text_column}`"), model_path).alias("e"))
    return rows.select("doc_id", (F.octet_length("e.ids") / 4).cast("long").alias("n_tokens"), "e.ids", "e.starts", "e.ends")
