"""SentencePiece encoding and decoding for merge-type (BPE) models.

Encoding is exact without running merges over the text. An Aho-Corasick
automaton gives the longest vocabulary piece at a place; the piece may follow
the one before it only if the two, joined and merged afresh, come out as these
two again (such verdicts are remembered); otherwise the next shorter piece is
tried, and where none is left the last piece is taken back. A field of one mark
a place holds those from which no valid ending was found, so no place is tried
twice and the work grows with the length of the word.

White space becomes the mark U+2581, and no piece has a mark after another
character, so merging never crosses the start of a run of marks: a text is the
sequence of its words. The ids of a word are remembered in a bounded table. New
words are cut further into letters and the rest; the
pieces of a chunk are remembered too, and two chunks whose
touching pieces do not fit are joined and encoded as one. In a run of several
marks only the last can belong to the word, because pieces of
marks alone have the lowest score; what is left of the run is merged afresh.

Defined results: a null text counts as empty and has only the end id; null or
repeated doc_ids are rows like any other; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Letters and digits with the marks before them, other characters, or marks alone.
CHUNKS = re.compile(f"{MARK}*\\w+|[^\\w{MARK}]+|{MARK}+")
#: Marks with what follows them, or what no mark precedes.
WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Entries of the table of fits, of some 150 bytes, of each of two generations of chunks, of some 300, and of words, of some 200.
REMEMBERED = 500_000
GENERATION = 250_000
#: Rows whose results are held at once.
SLICE = 256
NEVER = float("-inf")
LONGEST_REMEMBERED = 64


class PieceEncoder:
    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        proto = pb.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        kinds = {k: v.number for k, v in pb.ModelProto.SentencePiece.Type.DESCRIPTOR.values_by_name.items()}
        plain = [(i, p) for i, p in enumerate(proto.pieces) if p.type == kinds["NORMAL"]]
        if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("wants a merge-type model without text normalisation")
        if any(p.type in (kinds["USER_DEFINED"], kinds["UNUSED"]) for p in proto.pieces):
            raise ValueError("wants a model without user-defined or unused pieces")
        if any(re.search(f"[^{MARK}]{MARK}", p.piece) for _, p in plain):
            raise ValueError("wants a model whose pieces have no mark after another character")
        lowest = min(p.score for _, p in plain)
        if any(set(p.piece) == {MARK} and len(p.piece) > 1 and p.score > lowest for _, p in plain):
            raise ValueError("wants pieces of marks alone to have the lowest score")
        self.dummy_prefix = norm.add_dummy_prefix
        self.end_id = proto.trainer_spec.eos_id
        self.id_of = {p.piece: i for i, p in plain}
        self.score = {p.piece: p.score for _, p in plain}
        self.digits = [str(i) for i in range(len(proto.pieces))]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds["BYTE"]}
        # Only pieces that merging makes out of their own characters can come up.
        self.automaton = ahocorasick.Automaton()
        made = [x for x in self.id_of if len(x) == 1 or self.merge(x) == [x]]
        reachable = set(made)
        for x in made:
            self.automaton.add_word(x, (len(x) - 1, x))
        self.automaton.make_automaton()
        self.shorter = {x: next((x[:n] for n in range(len(x) - 1, 0, -1) if x[:n] in reachable), None) for x in made}
        self.fits_memo: dict[tuple[str, str], bool] = {}
        self.piece_of = {i: p.piece for i, p in plain}
        # Tables of tuples and strings alone: the collector of cycles soon leaves their entries out.
        self.memo: dict[str, tuple[tuple[int, ...], str, str]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str, str]] = {}  # the generation before; what is used again moves on
        self.words: dict[str, tuple[int, ...]] = {}  # of words after one mark, without it
        self.older_words: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> list[str]:
        """Merges the pair with the best score, leftmost first, until none is in the vocabulary."""
        return self.merge_short(text) if len(text) <= 32 else self.merge_long(text)

    def merge_short(self, text: str) -> list[str]:
        parts, score = list(text), self.score
        gains = [score.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while gains and (best := max(gains)) > NEVER:
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i < len(gains):
                gains[i] = score.get(parts[i] + parts[i + 1], NEVER)
            if i:
                gains[i - 1] = score.get(parts[i - 1] + parts[i], NEVER)
        return parts

    def merge_long(self, text: str) -> list[str]:
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (both := parts[i] + parts[j]) in self.score:
                heapq.heappush(heap, (-self.score[both], i, both, j))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both, j = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def fits(self, left: str, right: str) -> bool:
        """Whether right may follow left: merged afresh, the two are the same two."""
        key = (left, right)
        known = self.fits_memo.get(key)
        if known is None:
            if len(self.fits_memo) >= REMEMBERED:
                self.fits_memo.clear()
            known = self.fits_memo[key] = self.merge(left + right) == [left, right]
        return known

    def longest_at(self, word: str) -> list[str]:
        """The longest piece at each place; a character outside the vocabulary stands for itself."""
        best = list(word)
        for end, (back, piece) in self.automaton.iter(word):  # ends come in order, so the longest of a start comes last
            best[end - back] = piece
        return best

    def backtrack(self, word: str) -> list[str]:
        best = self.longest_at(word)
        n = len(word)
        closed = bytearray(n + 1)  # 1: no valid ending from this place
        out: list[str] = []
        at = 0
        piece: str | None = best[0]
        known, shorter, last = self.fits_memo.get, self.shorter.get, ""
        while at < n:
            while piece is not None:
                if not closed[at + len(piece)]:
                    if not out:
                        break
                    fit = known((last, piece))
                    if fit or fit is None and self.fits(last, piece):
                        break
                piece = shorter(piece)
            if piece is None:
                if not out:
                    raise ValueError("no valid sequence of pieces")
                closed[at] = 1
                taken = out.pop()
                at -= len(taken)
                piece = shorter(taken)
                last = out[-1] if out else ""
                continue
            out.append(piece)
            last = piece
            at += len(piece)
            piece = best[at] if at < n else None
        return out

    def chunk(self, chunk: str) -> tuple[tuple[int, ...], str, str]:
        """The ids of a chunk, its first and its last piece."""
        found = self.memo.get(chunk)
        if found is not None:
            return found
        found = self.older.get(chunk)
        if found is None and chunk[0] == MARK and (ids := self.words.get(chunk[1:])):
            ends = self.piece_of.get(ids[0]), self.piece_of.get(ids[-1])
            if None not in ends:  # a byte does not tell its character
                return ids, *ends
        if found is None:
            found = self.cut(chunk)
        return self.remember(chunk, found) if len(chunk) <= LONGEST_REMEMBERED else found

    def cut(self, chunk: str) -> tuple[tuple[int, ...], str, str]:
        bare = chunk.lstrip(MARK)
        marks = len(chunk) - len(bare)
        if marks <= 1 and bare:
            pieces = self.backtrack(chunk)
        elif not bare:
            pieces = self.merge(chunk)
        else:
            pieces = self.backtrack(MARK + bare)
            alone = pieces[0] == MARK
            pieces = self.merge(MARK * (marks - 1 + alone)) + pieces[alone:]
        try:
            return tuple([self.id_of[p] for p in pieces]), pieces[0], pieces[-1]
        except KeyError:
            if not self.byte_id:
                raise ValueError("wants a model with byte fallback") from None
        ids: list[int] = []
        for p in pieces:
            ids += [self.id_of[p]] if p in self.id_of else [self.byte_id[b] for b in p.encode()]
        return tuple(ids), pieces[0], pieces[-1]

    def remember(self, chunk: str, found: tuple[tuple[int, ...], str, str]) -> tuple[tuple[int, ...], str, str]:
        if len(self.memo) >= GENERATION:
            self.older, self.memo = self.memo, {}
        self.memo[chunk] = found
        return found

    def encode(self, text: str) -> list[int]:
        """The ids of text, without an end id."""
        if not text:
            return []
        if not self.dummy_prefix or MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            out: list[int] = []
            for w in WORDS.findall((MARK if self.dummy_prefix else "") + text.replace(" ", MARK)):
                out += self.word(w[1:]) if w[0] == MARK and len(w) > 1 and w[1] != MARK else self.join(w)
            return out
        words = text.split(" ")  # each follows one mark
        found = list(map(self.words.get, words))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self.word(words[i])
        return list(chain.from_iterable(found))

    def word(self, bare: str) -> tuple[int, ...]:
        """The ids of a mark with bare, which has none, after it."""
        ids = self.words.get(bare) or self.older_words.get(bare) or self.join(MARK + bare)
        if len(bare) < LONGEST_REMEMBERED:
            if len(self.words) >= GENERATION:
                self.older_words, self.words = self.words, {}
            self.words[bare] = ids
        return ids

    def join(self, word: str) -> tuple[int, ...]:
        """The ids of a word, by its chunks: one that does not fit the chunk before is encoded with it."""
        chunks = CHUNKS.findall(word)
        if len(chunks) == 1:
            return self.cut(word)[0]  # the word is remembered
        settled: list[tuple[str, tuple[int, ...], str]] = []  # chunks before the last, for joining further back
        known = self.fits_memo.get
        held, ids, last = "", (), ""  # the last chunk, which may still be joined with the next
        for c in chunks:
            found = self.chunk(c)
            while held:
                fit = known((last, found[1]))
                if fit or fit is None and self.fits(last, found[1]):
                    settled.append((held, ids, last))
                    break
                c = held + c
                found = self.chunk(c)
                held, ids, last = settled.pop() if settled else ("", (), "")
            held = c
            ids, _, last = found
        return (*chain.from_iterable([x[1] for x in settled]), *ids)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_encoders: dict[str, PieceEncoder] = {}


def encoder(model_path: str) -> PieceEncoder:
    if model_path not in _encoders:
        _encoders[model_path] = PieceEncoder(model_path)
    return _encoders[model_path]


@contextmanager
def no_collection() -> Iterator[None]:
    """Encoding makes no cycles, and its tables hold so many objects that looking for some takes a quarter of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def piece_tokens(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids (with the end id), decoded, and their digests."""

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path)
        digits = e.digits.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n, id_digests, text_digests, all_ids, texts = [], [], [], [], []
                with no_collection():
                    for text in part.column("text"):
                        ids = e.encode(text.as_py() or "")
                        ids.append(e.end_id)
                        decoded = e.decode(ids)
                        n.append(len(ids))
                        id_digests.append(hashlib.sha256(" ".join(map(digits, ids)).encode()).hexdigest())
                        text_digests.append(hashlib.sha256(decoded.encode()).hexdigest())
                        if with_ids:
                            all_ids.append(ids)
                            texts.append(decoded)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
                if with_ids:
                    columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return _whole_ids(docs).mapInArrow(run, schema)


def _whole_ids(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text")
