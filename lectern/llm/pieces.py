"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece they
would form (best first, then leftmost) and merges until the agenda is empty; symbols outside
the vocabulary fall back to byte pieces. No piece of such a vocabulary continues across the
start of a new run of space marks, so a text is cut there and each distinct chunk is encoded
once per worker and kept in a bounded memo. Every chunk entering the memo is checked against
the sentencepiece library, ids and decoded text both, in the Arrow batch where it first occurs.

Defined cases: null text encodes as the empty text (no ids, decoded ''); any length of text is
processed whole; repeated rows each give a row; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: New chunks a Python worker keeps before the older ones go.
MEMO_CHUNKS = 200_000
_NONE = float("inf")
#: Chunks of up to so many characters are encoded together, those of one length as the rows of a table.
TOGETHER_CHARS = 40
#: New chunks that are encoded and checked at once.
LEARNED = 20_000
#: Longer chunks are encoded each time they occur, so that the memo stays small.
MEMO_CHUNK_CHARS = 64


class PieceCodec:
    """Agenda encoder and decoder over one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib = self.library
        normal = [i for i in range(lib.get_piece_size()) if not (lib.is_unknown(i) or lib.is_control(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.piece_id = {lib.id_to_piece(i): i for i in normal}
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in normal}
        self.cost = {p: -s for p, s in self.score.items()}
        self.byte_id = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unk = lib.unk_id()
        self.surface = {i: lib.id_to_piece(i) for i in normal}
        # pairs of pieces that form a piece, by number: piece k is the k-th normal one, the number behind the last is a character
        # that is no piece, -1 is none
        self.place = {p: k for k, p in enumerate(self.piece_id)}
        self.numbers = np.array([*self.piece_id.values(), -1], np.int64)
        self.costs = np.array([*self.cost.values(), _NONE, _NONE])
        self.of_char = np.full(0x110000, len(self.place), np.int32)
        made: dict[int, int] = {}
        for p, k in self.place.items():
            if len(p) == 1:
                self.of_char[ord(p)] = k
            for i in range(1, len(p)):
                if (a := self.place.get(p[:i])) is not None and (b := self.place.get(p[i:])) is not None:
                    made[a * len(self.numbers) + b] = k
        self.pairs = np.array(sorted(made), np.int64)
        self.made = np.array([*(made[x] for x in sorted(made)), -1], np.int32)
        self.byte_value = {i: b for b, i in enumerate(self.byte_id) if lib.is_byte(i)}
        if any(SPACE in p.lstrip(SPACE) for p in self.piece_id):
            raise ValueError("the vocabulary has pieces that run across a space mark: chunks can't be encoded alone")
        if lib.encode("a  b ") != self._plain(f"{SPACE}a{SPACE}{SPACE}b{SPACE}"):
            raise ValueError("the model normalises texts; only identity normalisation with a leading space mark is supported")
        self.memo: dict[str, tuple[str, int]] = {}
        self.older: dict[str, tuple[str, int]] = {}
        #: Chunks whose decoded text is not the chunk itself.
        self.odd: dict[str, str] = {}

    def _plain(self, marked: str) -> list[int]:
        return [i for c in _CHUNK.findall(marked) for i in self.agenda(c)]

    def agenda(self, chunk: str) -> list[int]:
        """Ids of a chunk (space marks already in place)."""
        if len(chunk) <= TOGETHER_CHARS:
            return self._ids(self._short(chunk))
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        score, heap = self.score, []
        for i in range(n - 1):
            if (s := score.get(symbols[i] + symbols[i + 1])) is not None:
                heap.append((-s, i, i + 1, symbols[i] + symbols[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, j, made = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or right[i] != j or symbols[i] + symbols[j] != made:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = made, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (s := score.get(made + symbols[k])) is not None:
                    heapq.heappush(heap, (-s, i, k, made + symbols[k]))
            if (h := left[i]) >= 0 and (s := score.get(symbols[h] + made)) is not None:
                heapq.heappush(heap, (-s, h, i, symbols[h] + made))
        return self._ids([x for x in symbols if x is not None])

    def agendas(self, chunks: list[str]) -> list[list[int]]:
        """``agenda`` of many chunks. Those of one length are rows of a table, and each round makes the best merge of every row (the
        leftmost of equal ones), so rows stay of one length; a row without a merge is done."""
        out: list[list[int]] = [[]] * len(chunks)
        by_length: dict[int, list[int]] = {}
        for k, c in enumerate(chunks):
            by_length.setdefault(len(c), []).append(k)
        for n, at in by_length.items():
            if n > TOGETHER_CHARS:
                for k in at:
                    out[k] = self.agenda(chunks[k])
                continue
            points = np.frombuffer("".join([chunks[k] for k in at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            rows, row = self.of_char[points], np.array(at)
            made = np.full(rows.shape, -1, np.int32)  # what each symbol forms with the next one
            made[:, :-1] = self._made(rows[:, :-1], rows[:, 1:])
            while len(row):
                cost = self.costs[made]
                best = cost.argmin(axis=1)
                more = cost[np.arange(len(row)), best] < _NONE
                for k, ids in zip(row[~more].tolist(), self.numbers[rows[~more]].tolist(), strict=True):
                    out[k] = ids if -1 not in ids else self._with_bytes(chunks[k], ids)
                rows, made, row, best = rows[more], made[more], row[more], best[more]
                every, cols = np.arange(len(row)), np.arange(rows.shape[1])
                rows[every, best] = made[every, best]
                rows = rows[cols != best[:, None] + 1].reshape(len(row), len(cols) - 1)
                made = made[cols != best[:, None]].reshape(rows.shape)
                for side in (best - 1, best):  # the pairs of which the merged piece is the right or the left part
                    there = np.flatnonzero((side >= 0) & (side < len(cols) - 2))
                    i = side[there]
                    made[there, i] = self._made(rows[there, i], rows[there, i + 1])
        return out

    def _with_bytes(self, chunk: str, ids: list[int]) -> list[int]:
        """Ids of a chunk in which -1 stands for each character that is no piece: its bytes."""
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
                at += len(self.surface[i])
            else:
                out.extend([self.byte_id[b] for b in chunk[at].encode("utf-8")])
                at += 1
        return out

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of pieces forms, -1 if none."""
        key = a.astype(np.int64) * len(self.numbers) + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], -1) if len(self.pairs) else np.full(key.shape, -1, np.int32)

    def _short(self, chunk: str) -> list[str]:
        """The same agenda as a plain list: for short chunks its minimum is found faster than a heap is kept."""
        cost, none = self.cost, _NONE
        symbols = list(chunk)
        agenda = [cost.get(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := min(agenda)) is not none:
            i = agenda.index(best)
            symbols[i : i + 2] = [made := symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i:
                agenda[i - 1] = cost.get(symbols[i - 1] + made, none)
            if i < len(agenda):
                agenda[i] = cost.get(made + symbols[i + 1], none)
        return symbols

    def _ids(self, symbols: list[str]) -> list[int]:
        try:
            return [self.piece_id[x] for x in symbols]
        except KeyError:
            ids: list[int] = []
            for x in symbols:
                if (known := self.piece_id.get(x)) is not None:
                    ids.append(known)
                else:
                    ids.extend(self.byte_id[b] for b in x.encode("utf-8"))
            return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, byte runs as UTF-8 with U+FFFD for each bad byte, marks to
        spaces, the leading one dropped."""
        try:
            text = "".join([self.surface[i] for i in ids]).replace(SPACE, " ")
            return text[1:] if text[:1] == " " else text
        except KeyError:
            pass
        parts: list[str] = []
        run = bytearray()
        for i in ids:
            if (b := self.byte_value.get(i)) is not None:
                run.append(b)
                continue
            if run:
                parts.append(_utf8(run))
                run = bytearray()
            parts.append(self.surface.get(i, ""))
        if run:
            parts.append(_utf8(run))
        text = "".join(parts).replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text

    def _learn(self, chunks: list[str]) -> dict[str, tuple[str, int]]:
        """Encode chunks by agenda and check them against the library in one batch.

        Every chunk starts with a space mark (the first one of a text gets it from the model), and
        the library puts one before each text: the chunk is handed over without it.
        """
        ids = self.agendas(chunks)
        texts = [c[1:].replace(SPACE, " ") for c in chunks]
        asked = [k for k, t in enumerate(texts) if t]  # a lone mark: the library reads '' as no text
        theirs = self.library.encode([texts[k] for k in asked], num_threads=1)
        back = self.library.decode(theirs) if theirs else []
        for k, own, text in zip(asked, theirs, back, strict=True):
            if own != ids[k] or text != (mine := self.decode(ids[k])):
                raise ValueError(f"agenda and library differ on {chunks[k][:100]!r}")
            if mine != texts[k]:
                self.odd[chunks[k]] = mine
        return {c: (",".join(map(str, i)), len(i)) for c, i in zip(chunks, ids, strict=True)}

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, each with its leading space marks."""
        if not text:
            return []
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")
        return _CHUNK.findall(SPACE + text.replace(" ", SPACE))

    def digest(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, sha256 of the joined ids, sha256 of the decoded text) of each text."""
        split = [self.chunks(t) for t in texts]
        if len(self.memo) > MEMO_CHUNKS:  # the older half goes, frequent chunks come back from it
            self.memo, self.older = {}, self.memo
            self.odd = {c: t for c, t in self.odd.items() if c in self.older}
        memo, older = self.memo, self.older
        asked = set().union(*split).difference(memo) if split else set()
        memo.update({c: older[c] for c in asked if c in older})
        new = [c for c in asked if c not in older]
        for k in range(0, len(new), LEARNED):
            memo.update(self._learn(new[k : k + LEARNED]))
        long = [c for c in asked if len(c) > MEMO_CHUNK_CHARS]
        for t, cs in zip(texts, split, strict=True):
            got = [memo[c] for c in cs]
            ids = ",".join([g[0] for g in got])
            # each chunk has been decoded when it was learned; only where that gave another text is it joined anew
            text = t.replace(SPACE, " ") if self.odd.keys().isdisjoint(cs) else "".join([" " + self.odd.get(c, c[1:].replace(SPACE, " ")) for c in cs])[1:]
            yield sum([g[1] for g in got]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        for c in long:
            memo.pop(c, None)
            self.odd.pop(c, None)

    def encode(self, text: str | None) -> list[int]:
        return self._plain(SPACE + text.replace(" ", SPACE)) if text else []


def _utf8(run: bytearray) -> str:
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i : i + n].decode("utf-8"))
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("�")
        i += n
    return "".join(out)


class HeldCodec:
    """The codec of a model, made once per Python worker that gets this as a broadcast value. Spark drops the value, and with it
    the memo, when the worker goes on with a task that doesn't use it: workers are kept for later work."""

    def __init__(self, model_file: str):
        self.model_file, self.made = model_file, None

    def __getstate__(self):
        return self.model_file

    def __setstate__(self, model_file):
        self.__init__(model_file)

    def codec(self) -> PieceCodec:
        if self.made is None:
            self.made = PieceCodec(self.model_file)
        return self.made


def _few(batch: pa.RecordBatch, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of some ``chars`` characters, so that a batch of long texts stays small."""
    sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for k, s in enumerate(sizes):
        if total and total + s > chars:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += int(s)
    if start < batch.num_rows:
        yield batch.slice(start)


def piece_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256."""

    held = docs.sparkSession.sparkContext.broadcast(HeldCodec(model_file))  # a file's name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value.codec()
        for whole in batches:
            for b in _few(whole):
                rows = list(own.digest([t or "" for t in b["text"].to_pylist()]))
                n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = slim.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return made.withColumnRenamed("id", id_col)


def piece_ids(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (array of int), decoded (the text of those ids)."""

    held = docs.sparkSession.sparkContext.broadcast(HeldCodec(model_file))  # a file's name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value.codec()
        for whole in batches:
            for b in _few(whole):
                ids = [own.encode(t) for t in b["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(i) for i in ids], pa.string())], ["id", "ids", "decoded"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)
