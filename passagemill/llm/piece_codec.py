"""Encoding and decoding with SentencePiece merge-type vocabularies.

Method. A text's characters are symbols; an agenda holds the adjacent pairs whose joined string
is a piece, ordered by the piece's score and then from left to right; the best pair merges, its
new neighbours enter the agenda, until it is empty. Symbols that are no piece become the byte
pieces of their UTF-8. Blanks are written as U+2581 and one is put before the text.

Units. If no piece has U+2581 after another character or holds a line end (checked when the
model is read), no merge crosses the place before a run of blanks or beside a line end, so a
text's ids are its units' ids, one after the other. Units are kept in a table of bounded size.
Those of an Arrow batch that are not in it run through one agenda together: in each round every
unit takes its best pair off, with numpy. Units over ``LONG`` symbols have a heap each.
The ids of those units are then compared with the sentencepiece library's own, batch by batch.

Defined results. A null or empty text has the begin and end ids alone and decodes to the empty
text. Repeated rows give repeated results; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship, slices

BLANK = "▁"
LONG = 48
UNITS = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")


class PieceCodec:
    def __init__(self, model_path: str, keep: int = 200_000):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = lib.piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        if any(BLANK in self.pieces[i].lstrip(BLANK) or "\n" in self.pieces[i] for i in normal):
            raise ValueError("a piece of this model crosses a blank or a line end; units would not be exact")
        probe = "a  b Åﬁ\t c"
        if lib.normalize(probe) != BLANK + probe.replace(" ", BLANK):
            raise ValueError("this model normalises text; only identity normalisation is built")
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(size) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.silent = {i for i in range(size) if lib.is_control(i)}
        id_of = {self.pieces[i]: i for i in normal}
        # symbols are ids; characters that only occur inside pieces get numbers beyond the vocabulary
        self.symbols = dict(id_of)
        for i in normal:
            for c in self.pieces[i]:
                self.symbols.setdefault(c, len(self.pieces) + len(self.symbols))
        self.base = max(self.symbols.values()) + 2
        self.none = self.base - 1  # a character of no piece
        left, right, made = [], [], []
        for i in normal:
            piece = self.pieces[i]
            for k in range(1, len(piece)):
                if piece[:k] in self.symbols and piece[k:] in self.symbols:
                    left.append(self.symbols[piece[:k]]), right.append(self.symbols[piece[k:]]), made.append(i)
        keys = np.array(left, np.int64) * self.base + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.made = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.array(made, np.int64)[order], 0)
        self.pair = dict(zip(self.keys.tolist(), self.made.tolist(), strict=True))
        # ranks keep the scores' order exactly; pieces of equal scores share one, and the leftmost pair wins
        scores = np.array([lib.get_score(i) for i in range(size)])
        self.rank = np.full(self.base, np.inf, np.float32)
        self.rank[normal] = np.unique(-scores[normal], return_inverse=True)[1]
        if len(normal) >= 2**24:
            raise ValueError("more pieces than 32-bit floats can rank")
        self.units: dict[str, tuple[bytes, str]] = {}
        self.keep = keep

    # -- agenda -----------------------------------------------------------------------------

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        made = np.where(self.keys[at] == key, self.made[at], self.none)
        return self.rank[made], made

    def agenda(self, units: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of units of at most LONG characters, merged together round by round."""
        lengths = np.array([len(u) for u in units], np.int64)
        width = int(lengths.max())
        flat = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        chars, back = np.unique(flat, return_inverse=True)
        known = np.array([self.symbols.get(chr(c), self.none) for c in chars], np.int64)
        n = len(units)
        cells = np.arange(width) < lengths[:, None]
        symbol = np.full((n, width + 1), self.none, np.int64)
        symbol[:, :width][cells] = known[back]
        code = np.zeros((n, width), np.int64)
        code[cells] = flat
        after = np.tile(np.arange(1, width + 2), (n, 1))  # the next symbol's place
        before = np.tile(np.arange(-1, width), (n, 1))
        alive = cells.copy()
        best = np.full((n, width + 1), np.inf, np.float32)
        made = np.full((n, width + 1), self.none, np.int64)
        inner = np.arange(width) < lengths[:, None] - 1
        r, c = np.nonzero(inner)
        best[r, c], made[r, c] = self._pair_rank(symbol[r, c], symbol[r, c + 1])
        rows = np.arange(n)
        while len(rows):
            at = best[rows].argmin(axis=1)
            going = best[rows, at] < np.inf
            rows, at = rows[going], at[going]
            if not len(rows):
                break
            gone = after[rows, at]
            symbol[rows, at] = made[rows, at]
            alive[rows, gone] = False
            best[rows, gone] = np.inf
            following = after[rows, gone]
            after[rows, at] = following
            has = following < lengths[rows]
            best[rows, at] = np.inf
            rr, aa, ff = rows[has], at[has], following[has]
            before[rr, ff] = aa
            best[rr, aa], made[rr, aa] = self._pair_rank(symbol[rr, aa], symbol[rr, ff])
            prior = before[rows, at]
            has = prior >= 0
            rr, aa, pp = rows[has], at[has], prior[has]
            best[rr, pp], made[rr, pp] = self._pair_rank(symbol[rr, pp], symbol[rr, aa])
        ends = 4 * np.cumsum(alive.sum(axis=1))
        ids = symbol[:, :width][alive]
        packed = ids.astype("<u4").tobytes()
        out = [packed[i:k] for i, k in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        if (odd := ids >= len(self.pieces)).any():
            owner = np.repeat(rows_of := np.arange(n), alive.sum(axis=1))
            codes = code[alive]
            for row in rows_of[np.unique(owner[odd])].tolist():
                mine = owner == row
                unit = [i for k, c in zip(ids[mine].tolist(), codes[mine].tolist(), strict=True) for i in ([k] if k < len(self.pieces) else self._bytes(chr(c)))]
                out[row] = np.array(unit, "<u4").tobytes()
        return out

    def long_agenda(self, unit: str) -> bytes:
        """The same for one unit of any length, by a heap."""
        symbol = [self.symbols.get(c, self.none) for c in unit]
        n = len(symbol)
        after, before, version = [*range(1, n + 1)], [*range(-1, n - 1)], [0] * n
        heap = []

        def push(k: int) -> None:
            if k >= 0 and after[k] < n and (m := self.pair.get(symbol[k] * self.base + symbol[after[k]])) is not None:
                heapq.heappush(heap, (float(self.rank[m]), k, m, version[k], version[after[k]]))

        for k in range(n):
            push(k)
        while heap:
            _, k, m, mine, other = heapq.heappop(heap)
            if version[k] != mine or after[k] >= n or version[after[k]] != other:
                continue
            gone = after[k]
            symbol[k], after[k] = m, after[gone]
            version[k] += 1
            version[gone] = -1
            if after[k] < n:
                before[after[k]] = k
            push(k)
            push(before[k])
        out, k = [], 0
        while k < n:
            out += [symbol[k]] if symbol[k] < len(self.pieces) else self._bytes(unit[k])
            k = after[k]
        return np.array(out, "<u4").tobytes()

    def _bytes(self, character: str) -> list[int]:
        return [self.bytes.get(b, self.unk) for b in character.encode()] if self.bytes else [self.unk]

    # -- texts ------------------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """Units of a text, written with U+2581."""
        if not text:
            return []
        if "  " in text or " \n" in text or "\n " in text or BLANK in text or text[-1] == " " or text[0] in " \n":
            return UNITS.findall(BLANK + text.replace(" ", BLANK))
        # the common case: single blanks and line ends between words
        return f" {text}".replace("\n", " \n ").replace(" ", f" {BLANK}").replace(f"{BLANK}\n {BLANK}", "\n ").split(" ")[1:]

    def learn(self, texts: list[list[str]], check: bool = True) -> None:
        """Put the units of a batch that are not known yet into the table."""
        if len(self.units) > self.keep:
            for unit in list(self.units)[self.keep * 3 // 4 :]:
                del self.units[unit]
        new = list({u for units in texts for u in units if u not in self.units and u})
        new.sort(key=len)
        short = [u for u in new if len(u) <= LONG]
        ids: list[bytes] = []
        for start in range(0, len(short), 4096):
            ids += self.agenda(short[start : start + 4096])
        ids += [self.long_agenda(u) for u in new[len(short) :]]
        if check and new:
            self.compare(new, ids)
        for unit, own in zip(new, ids, strict=True):
            self.units[unit] = (own, self.pieced(np.frombuffer(own, "<u4").tolist()))

    def compare(self, units: list[str], ids: list[bytes]) -> None:
        """Raise if the library encodes these units differently."""
        joined, own = [], []
        for unit, i in zip(units, ids, strict=True):
            if unit[0] == BLANK != unit[-1]:  # the library puts a blank before whatever it is asked, and would join runs of them
                joined.append(unit)
                own.append(i)
        if joined and self.library.encode("".join(joined)[1:].replace(BLANK, " ")) != np.frombuffer(b"".join(own), "<u4").tolist():
            for unit, i in zip(units, ids, strict=True):
                if unit[0] == BLANK != unit[-1] and self.library.encode(unit[1:].replace(BLANK, " ")) != np.frombuffer(i, "<u4").tolist():
                    raise ValueError(f"the library encodes {unit!r} differently")
            raise ValueError("the library encodes these units differently together")

    def pieced(self, ids: list[int]) -> str:
        """The string of a unit's ids, with U+2581 as a blank."""
        plain = "".join([self.pieces[i] for i in ids])
        if "<" not in plain:
            return plain.replace(BLANK, " ")
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i not in self.silent:
                out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(BLANK, " ")

    def encode(self, text: str) -> list[int]:
        units = self.split(text)
        self.learn([units])
        return [self.bos, *np.frombuffer(b"".join(self.units[u][0] for u in units if u), "<u4").tolist(), self.eos]

    def decode(self, ids: list[int]) -> str:
        return self.pieced(ids)[1:] if ids and len(ids) > len([i for i in ids if i in self.silent]) else ""


@lru_cache(maxsize=2)
def codec_of_model(path: str) -> PieceCodec:
    """One table of units for each Python worker, kept from task to task."""
    return PieceCodec(path)


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = True, check: bool = True) -> DataFrame:
    """doc_id, ids (array<int>, begin and end ids included; left out on request), decoded, and digests of both."""
    ship(docs.sparkSession)
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(fields)

    def run(batches):
        codec = codec_of_model(model_path)
        begin, end = codec.bos.to_bytes(4, "little"), codec.eos.to_bytes(4, "little")
        for batch in slices(batches):
            texts = [codec.split(t or "") for t in batch.column("text").to_pylist()]
            codec.learn(texts, check)
            ids, decoded, n, ids_sha, decoded_sha = [], [], [], [], []
            for units in texts:
                pairs = [codec.units[u] for u in units if u]
                own = begin + b"".join([p[0] for p in pairs]) + end
                text = "".join([p[1] for p in pairs])[1:]
                n.append(len(own) // 4)
                ids_sha.append(hashlib.sha256(own).hexdigest())
                decoded_sha.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                    decoded.append(text)
            more = [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *more, pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
