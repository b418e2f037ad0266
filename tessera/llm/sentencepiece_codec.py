"""SentencePiece encoding and decoding by a max-plus parallel scan.

Encoding finds the segmentation of a normalised text into pieces of greatest summed score. A giant text is split into
chunks at fixed lengths, with no regard to words. A piece can reach from one chunk into the next by less than the longest
piece's length L, so what a chunk needs to know of the text before it is how many of its first characters are already
taken: a state of 0 to L - 1. A chunk yields a matrix of best scores from entry state to exit state; matrices combine by
(max, +), which is associative, and a scan of them gives each chunk its entry and exit. Then every chunk is traced back
by itself. Chunks are rows of a table, spread over all tasks.

Scores of equal segmentations are equal integers or dyadic fractions for the vocabularies used here, and ties go to the
longer last piece, as they do in one pass over the whole text.

That is how a unigram model segments. A file that was made for merging (BPE) is encoded by its merges instead, by
`merges_digested`, which gives the ids of the file's own library. A giant text is cut where no merge can cross: between
two characters that stand side by side in no piece.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty, written

SPACE = "▁"
#: Characters of a chunk. Texts of up to one chunk are encoded at once.
CHUNK = 16384
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: What an unknown character costs below the least score, as the library has it.
UNKNOWN_PENALTY = 10.0
NEVER = -1e300


class Vocabulary:
    """Pieces by text with (score, id), byte pieces, and the unknown id."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {self.pieces[i]: (model.get_score(i), i) for i in normal}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = model.unk_id()
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.longest = max(map(len, self.score), default=1)
        self.unknown_score = min((s for s, _ in self.score.values()), default=0.0) - UNKNOWN_PENALTY
        self.starts = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        self.inner_space = any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.words: dict[str, tuple[list[int], float]] = {}

    def ends(self, text: str, at: int) -> Iterator[tuple[int, float, int]]:
        """(end, score, id) of each piece of text at a place, shorter ones first; an unknown character if none has its
        length."""
        single = False
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            part = text[at:end]
            if part not in self.starts:
                break
            if part in self.score:
                single |= end == at + 1
                yield (end, *self.score[part])
        if not single:
            yield at + 1, self.unknown_score, self.unknown


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


def normalised(text: str) -> str:
    """Spaces as the meta symbol, one in front: the identity rule with a dummy prefix and no other change."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def _forward(v: Vocabulary, text: str, begin: int, end: int, entry: int) -> np.ndarray:
    """Best scores of reaching end + j (exit state j) from begin + entry by pieces that start before end."""
    best = np.full(max(end - begin, entry) + v.longest, NEVER)
    best[entry] = 0.0
    for at in range(begin + entry, end):
        here = best[at - begin]
        if here > NEVER:
            for stop, score, _ in v.ends(text, at):
                best[stop - begin] = max(best[stop - begin], here + score)
    return best[end - begin : end - begin + v.longest]


def matrix(v: Vocabulary, text: str, begin: int, end: int) -> np.ndarray:
    """The chunk's transfer matrix, entry state by exit state. text holds the chunk and the next longest - 1 characters.

    Paths from different entries soon meet: where no place but one is a boundary of all segmentations, the rest is
    shared. That place is found first; from it on one pass serves all entries."""
    out = np.full((v.longest, v.longest), NEVER)
    meet = _common_place(v, text, begin, end)
    if meet is None:
        for entry in range(v.longest):
            out[entry] = _forward(v, text, begin, end, entry)
        return out
    last = max(meet, _last_cut(text, meet, end))
    rest = _forward(v, text, last, end, 0)
    rest = np.where(rest > NEVER, rest + sum(remembered(v, w)[1] for w in WORDS.findall(text[meet:last])), NEVER)
    for entry in range(min(v.longest, meet - begin + 1)):
        first = _forward(v, text, begin, meet, entry)[0] if begin + entry < meet else 0.0
        if first > NEVER:
            out[entry] = np.where(rest > NEVER, rest + first, NEVER)
    return out


def _common_place(v: Vocabulary, text: str, begin: int, end: int) -> int | None:
    """The first place, not before all entry states, that no piece of the vocabulary can cross."""
    if v.inner_space:
        return None
    at = text.find(SPACE, begin + v.longest, end)
    while at > 0 and text[at - 1] == SPACE:
        at = text.find(SPACE, at + 1, end)
    return at if at > 0 else None


def _last_cut(text: str, begin: int, end: int) -> int:
    """The last place before end where a space follows another character."""
    at = text.rfind(SPACE, begin + 1, end)
    while at > begin and text[at - 1] == SPACE:
        at = text.rfind(SPACE, begin + 1, at)
    return at


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    out = (a[:, :, None] + b[None, :, :]).max(axis=1)
    return np.where(out < NEVER / 2, NEVER, out)


def best_word(v: Vocabulary, word: str) -> tuple[list[int], float]:
    """(ids, score) of a stretch that no piece reaches into or out of."""
    n, get, longest = len(word), v.score.get, v.longest
    best, back = [0.0] * (n + 1), [(0, 0)] * (n + 1)
    for end in range(1, n + 1):
        top, how = NEVER, (0, 0)
        for start in range(max(0, end - longest), end):
            found = get(word[start:end])
            if found is not None and best[start] + found[0] > top:  # an earlier start stays at a tie
                top, how = best[start] + found[0], (start, found[1])
        if word[end - 1] not in v.score and best[end - 1] + v.unknown_score > top:
            top, how = best[end - 1] + v.unknown_score, (end - 1, v.unknown)
        best[end], back[end] = top, how
    pieces, at = [], n
    while at:
        start, piece = back[at]
        pieces.append((start, at, piece))
        at = start
    return to_ids(v, word, pieces[::-1]), best[n]


def remembered(v: Vocabulary, word: str) -> tuple[list[int], float]:
    found = v.words.get(word)
    if found is None:
        found = best_word(v, word)
        if len(word) <= 64:
            if len(v.words) > 300_000:
                v.words.clear()
            v.words[word] = found
    return found


def trace(v: Vocabulary, text: str, begin: int, end: int, entry: int, leave: int) -> list[int]:
    """The ids of the best pieces from begin + entry to end + leave, both of which are ends of pieces. Where no piece
    holds a space inside, words are encoded one by one and remembered."""
    here = text[begin + entry : end + leave]
    if v.inner_space:
        return best_word(v, here)[0] if here else []
    out: list[int] = []
    for word in WORDS.findall(here):
        out += remembered(v, word)[0]
    return out


def to_ids(v: Vocabulary, text: str, pieces: list[tuple[int, int, int]]) -> list[int]:
    """The pieces' ids; an unknown piece becomes its bytes where the vocabulary has them, else the unknown id, once for
    unknown pieces in a row."""
    if all(p[2] != v.unknown for p in pieces):
        return [p[2] for p in pieces]
    out: list[int] = []
    was = False
    for start, end, piece in pieces:
        if piece != v.unknown:
            out.append(piece)
        elif v.byte_ids:
            out += [v.byte_ids[b] for b in text[start:end].encode()]
        elif not was:
            out.append(piece)
        was = piece == v.unknown
    return out


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The text of ids: byte pieces in a row as UTF-8, meta symbols as spaces, the dummy prefix taken off."""
    parts: list[bytes] = []
    for i in ids:
        if i in v.bytes_of:
            parts.append(bytes([v.bytes_of[i]]))
        elif i not in v.silent:
            parts.append((" ⁇ " if i == v.unknown else v.pieces[i]).encode())
    text = b"".join(parts).decode(errors="replace").replace(SPACE, " ")
    return text.removeprefix(" ")


def scan(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(entry, exit) of each chunk on the best path from state 0 to the text's end.

    Prefix products from the left give the best score into each state; going back from the end picks the states."""
    n = matrices[0].shape[0]
    into = [np.where(np.arange(n) == 0, 0.0, NEVER)]
    for m in matrices:
        into.append(combine(into[-1][None, :], m)[0])
    state, states = 0, [0]
    for k in range(len(matrices) - 1, -1, -1):
        state = int((into[k] + matrices[k][:, state]).argmax())
        states.append(state)
    states.reverse()
    return list(zip(states[:-1], states[1:], strict=True))


def encode(v: Vocabulary, text: str) -> list[int]:
    """The ids of one text, in this process; what the distributed scan gives too."""
    whole = normalised(text)
    return trace(v, whole, 0, len(whole), 0, 0)


def encoded(docs: DataFrame, model_file: str, chunk: int = CHUNK) -> DataFrame:
    """(row, doc_id, chunk, ids, text_crc32): the ids of each row of docs(doc_id, text), a row per chunk. A text longer
    than a chunk goes through the scan: matrices per chunk, their products per text, a trace per chunk."""

    def cut(batches) -> Iterator[pa.RecordBatch]:
        longest, row = vocabulary(model_file).longest, TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row += 1
                whole = normalised(text.as_py())
                spans = range(0, max(len(whole), 1), chunk)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(spans), pa.int64()), pa.array([doc_id] * len(spans), pa.int64()), pa.array([at // chunk for at in spans], pa.int32()), pa.array([len(spans)] * len(spans), pa.int32()), pa.array([min(chunk, len(whole) - at) for at in spans], pa.int32()), pa.array([whole[at : at + chunk + longest - 1] for at in spans], pa.string())], ["row", "doc_id", "chunk", "chunks", "length", "text"])

    schema = "row long, doc_id long, chunk int, chunks int, length int, text string"
    parts = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("string").alias("text")).mapInArrow(cut, schema)
    short = parts.filter("chunks = 1").withColumns({"entry": F.lit(0), "leave": F.lit(0)})
    giant = written(parts.filter("chunks > 1"), "giant-chunks")

    def matrices(batches) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        for batch in batches:
            out = [matrix(v, text, 0, length).tobytes() for length, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["row", "chunk", "matrix"])

    def states(key, group):
        group = group.sort_by("chunk")
        n = vocabulary(model_file).longest
        found = scan([np.frombuffer(m, dtype=np.float64).reshape(n, n) for m in group["matrix"].to_pylist()])
        return pa.table([group["row"], group["chunk"], pa.array([a for a, _ in found], pa.int32()), pa.array([b for _, b in found], pa.int32())], names=["row", "chunk", "entry", "leave"])

    spread = giant.repartition(F.col("row"), F.col("chunk"))
    paths = spread.select("row", "chunk", "length", "text").mapInArrow(matrices, "row long, chunk int, matrix binary").groupBy("row").applyInArrow(states, "row long, chunk int, entry int, leave int")
    long = giant.join(paths, ["row", "chunk"])

    def backtrace(batches) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        for batch in batches:
            ids = []
            for length, text, entry, leave in zip(*[c.to_pylist() for c in batch.columns[3:]], strict=True):
                ids.append(trace(v, text, 0, length, entry, leave))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int32()))], ["row", "doc_id", "chunk", "ids"])

    out = "row long, doc_id long, chunk int, ids array<int>"
    columns = ["row", "doc_id", "chunk", "length", "text", "entry", "leave"]
    return short.select(*columns).mapInArrow(backtrace, out).unionByName(long.select(*columns).mapInArrow(backtrace, out))


def digested(docs: DataFrame, model_file: str, chunk: int = CHUNK) -> DataFrame:
    """Encodes each row of docs(doc_id, text), decodes the ids again: doc_id, n_pieces, ids_crc32 (of the ids as
    little-endian unsigned 32-bit numbers), text_crc32 (of the decoded text's UTF-8), decoded_chars; a row per input
    row. A null text counts as empty and has no pieces; repeated rows and null ids keep a row each; other columns are
    not looked at; an empty table gives no row. A giant text's chunks of ids come together in its own row only."""

    return _joined(encoded(docs, model_file, chunk), model_file)


DIGESTS = "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long, decoded_chars long"


def _digests(v: Vocabulary, doc_ids: pa.Array, lists: list[list[int]]) -> pa.RecordBatch:
    rows = []
    for ids in lists:
        text = decode(v, ids)
        rows.append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), zlib.crc32(text.encode()), len(text)))
    columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
    return pa.RecordBatch.from_arrays([doc_ids, *columns], ["doc_id", "n_pieces", "ids_crc32", "text_crc32", "decoded_chars"])


def _joined(found: DataFrame, model_file: str) -> DataFrame:
    """The digests of (row, doc_id, chunk, ids), whose chunks come together by row."""

    def join(batches) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        for batch in batches:
            yield _digests(v, batch.column(0), [[i for part in sorted(parts, key=lambda p: p["chunk"]) for i in part["ids"]] for parts in batch.column(1).to_pylist()])

    whole = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.collect_list(F.struct("chunk", "ids")).alias("parts"))
    return whole.select("doc_id", "parts").mapInArrow(join, DIGESTS)


class Merges:
    """The library's encoder of a merging model's file, over normalised texts and parts of them."""

    def __init__(self, model_file: str):
        import sentencepiece
        import sentencepiece.sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as file:
            model.ParseFromString(file.read())
        rule = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix:
            raise ValueError(f"{model_file} does not merge, or its rule is not the one of normalised()")
        rule.add_dummy_prefix = False  # normalised() has put it in front; a later part has none
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.single = {p.piece for p in model.pieces if len(p.piece) == 1}
        self.inside = {p.piece[k : k + 2] for p in model.pieces for k in range(len(p.piece) - 1)}

    def cuts(self, text: str, at: int) -> bool:
        """Whether no merge crosses a place. Two unknown characters stay together: the library can give them one id."""
        return text[at - 1 : at + 1] not in self.inside and (text[at - 1] in self.single or text[at] in self.single)

    def parts(self, whole: str, chunk: int) -> list[str]:
        """A normalised text in parts of at least `chunk` characters, but the last; each ends at the first cut."""
        out, begin = [], 0
        while len(whole) - begin > chunk:
            at = begin + chunk
            while at < len(whole) and not self.cuts(whole, at):
                at += 1
            out.append(whole[begin:at])
            begin = at
        return [*out, whole[begin:]] if begin < len(whole) or not out else out

    def encode(self, text: str) -> list[int]:
        """The ids of a part."""
        return self.library.encode(text)


@lru_cache(maxsize=2)
def merges(model_file: str) -> Merges:
    return Merges(model_file)


def merges_digested(docs: DataFrame, model_file: str, chunk: int = CHUNK) -> DataFrame:
    """As digested(), by the merges of a BPE file: the ids are those that the file's library gives the whole text. Texts
    of one part are done where they are, the parts of giant ones are spread over all tasks."""

    def cut(batches) -> Iterator[pa.RecordBatch]:
        m, row = merges(model_file), TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row += 1
                parts = m.parts(normalised(text.as_py()), chunk)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())], ["row", "doc_id", "chunk", "text"])

    def short(batches) -> Iterator[pa.RecordBatch]:
        v, m = vocabulary(model_file), merges(model_file)
        for batch in batches:
            yield _digests(v, batch.column(0), [m.encode(normalised(text.as_py())) for text in batch.column(1)])

    def by_part(batches) -> Iterator[pa.RecordBatch]:
        m = merges(model_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([m.encode(text.as_py()) for text in batch.column(3)], pa.list_(pa.int32()))], ["row", "doc_id", "chunk", "ids"])

    base = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("string").alias("text"))
    giant = F.length("text") >= chunk  # the dummy prefix is one more
    parts = written(base.filter(giant).mapInArrow(cut, "row long, doc_id long, chunk int, text string"), "giant-parts")
    found = parts.repartition(F.col("row"), F.col("chunk")).mapInArrow(by_part, "row long, doc_id long, chunk int, ids array<int>")
    return base.filter(~giant).mapInArrow(short, DIGESTS).unionByName(_joined(found, model_file))
