"""Encoding and decoding with a merge-type SentencePiece model.

A text has one merge encoding, and so has each of its prefixes. The prefix table
keeps the last token of every prefix: of the tokens that an automaton finds ending
there, it is the one that the last token of the prefix before it can stand beside.
Two tokens can stand side by side when no merge over their seam would come before the
merges that build them. The ids are read backwards from the end of the table.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from postmatch.llm.common import map_batches, texts, thin

SPACE = "▁"
UNKNOWN = -1
#: Longest part whose ids are remembered, and how many a generation remembers. Two
#: generations are kept; parts in use move to the younger one.
PART_CHARS, PARTS = 32, 300_000
PAIRS = 400_000


class PieceModel:
    """A merge-type model without text rules other than the leading space."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        self.eos = lib.eos_id()
        special = {i for i in ids if lib.is_control(i) or lib.is_unknown(i)}
        as_byte = {i: int(lib.id_to_piece(i)[3:-1], 16) for i in ids if lib.is_byte(i)}
        self.byte_id = {b: i for i, b in as_byte.items()}
        pieces = {i: lib.id_to_piece(i) for i in ids if i not in special and i not in as_byte}
        if any(lib.is_unused(i) for i in ids) or lib.encode("A Ａ ") != lib.encode(
                lib.decode(lib.encode("A Ａ "))):
            raise ValueError("models with unused pieces or text rules are not supported")
        self.id_of = {p: i for i, p in pieces.items()}
        self.score = {p: lib.get_score(i) for i, p in pieces.items()}
        self.unknown_id = lib.unk_id()
        self.piece = pieces
        self.automaton = ahocorasick.Automaton()
        for i, p in pieces.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        # A token never holds a space after another character: parts can be encoded alone.
        separable = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces.values())
        self.parts = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if separable else r"(?s).+").findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.forget_pairs()
        self.edges: dict[int, tuple[list[str], list[str]]] = {}
        self.id_text = [str(i) for i in ids]
        self.surface = [
            bytes([as_byte[i]]) if i in as_byte
            else " ⁇ ".encode() if lib.is_unknown(i)
            else b"" if i in special
            else pieces[i].replace(SPACE, " ").encode()
            for i in ids
        ]
        self.as_byte, self.special = as_byte, special

    def merged(self, piece: str) -> list[tuple[str, str]]:
        """The merges that build a piece on its own, in order."""
        parts, steps = list(piece), []
        while len(parts) > 1:
            options = [(-self.score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:]))
                       if a + b in self.score]
            if not options:
                break
            k = min(options)[1]
            steps.append((parts[k], parts[k + 1]))
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return steps if len(parts) == 1 else None

    def edge(self, token: int) -> tuple[list[str], list[str]] | None:
        """What stands at a token's left and right edge while it is being built."""
        if token not in self.edges:
            piece, steps = self.piece[token], None
            steps = self.merged(piece)
            if steps is None:
                self.edges[token] = None
            else:
                split = {a + b: (a, b) for a, b in steps}
                left, right = [piece], [piece]
                while left[-1] in split:
                    left.append(split[left[-1]][0])
                while right[-1] in split:
                    right.append(split[right[-1]][1])
                self.edges[token] = (left[::-1], right[::-1])
        return self.edges[token]

    def seam(self, a: int | None, b: int) -> bool:
        """Whether ``b`` can follow ``a``; equal scores merge from the left. At a text's
        start and after an unknown character every token can stand that merges build."""
        if self.edge(b) is None:
            return False
        if a is None or a == UNKNOWN:
            return True
        xs, ys, score = self.edge(a)[1], self.edge(b)[0], self.score
        i = j = 0
        least = float("-inf")
        while True:
            over = score.get(xs[i] + ys[j])
            after_x = score[xs[i + 1]] if i + 1 < len(xs) else least
            after_y = score[ys[j + 1]] if j + 1 < len(ys) else least
            if over is not None and over > after_x and over >= after_y:
                return False
            if i + 1 == len(xs) and j + 1 == len(ys):
                return True
            if j + 1 == len(ys) or (i + 1 < len(xs) and after_x >= after_y):
                i += 1
            else:
                j += 1

    def encode_part(self, part: str) -> tuple[int, ...]:
        # What may follow the last token of each prefix; None until a prefix has one.
        after: list[dict[int, bool] | None] = [None] * (len(part) + 1)
        last, size = [UNKNOWN] * (len(part) + 1), [1] * (len(part) + 1)
        after[0], anything, at = self.first, self.anything, 0
        beside, seam = self.beside, self.seam
        for end, (token, length) in self.automaton.iter(part):
            end += 1
            if end == at:
                continue
            while at < end - 1:  # characters that no piece ends on
                at += 1
                after[at] = anything
            follows = after[end - length]
            fits = follows.get(token)
            if fits is None:
                if self.pairs >= PAIRS:
                    self.forget_pairs()
                fits = follows[token] = seam(last[end - length] if end > length else None, token)
                self.pairs += 1
            if fits:
                last[end], size[end], at = token, length, end
                after[end] = beside.get(token)
                if after[end] is None:
                    after[end] = beside[token] = {}
        out: list[int] = []
        k = len(part)
        while k:
            token = last[k]
            if token == UNKNOWN:
                raw = part[k - 1].encode()
                out += [self.byte_id[x] for x in reversed(raw)] if self.byte_id else [self.unknown_id]
            else:
                out.append(token)
            k -= size[k]
        return tuple(reversed(out))

    def forget_pairs(self) -> None:
        """Starts the memory of pairs anew; tables in use keep what they hold."""
        self.beside: dict[int, dict[int, bool]] = {}
        self.first: dict[int, bool] = {}
        self.anything: dict[int, bool] = {}
        self.pairs = 0

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, with the end id last."""
        ids: list[int] = []
        known = self.known
        for part in self.parts(SPACE + text.replace(" ", SPACE)) if text else ():
            got = known.get(part)
            if got is None:
                got = self.older.get(part) or self.encode_part(part)
                if len(part) <= PART_CHARS:
                    if len(known) >= PARTS:
                        self.older, self.known = known, {}
                        known = self.known
                    known[part] = got
            ids.extend(got)
        ids.append(self.eos)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; a byte that is no UTF-8 becomes U+FFFD."""
        first = next((i for i in ids if i not in self.special or i == self.unknown_id), None)
        cut = 1 if first in self.piece and self.surface[first].startswith(b" ") else 0
        raw = b"".join(map(self.surface.__getitem__, ids))[cut:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            pass
        out, run = [], []  # bytes on both sides of an end id are not one character
        for i in ids:
            if i in self.special and i != self.unknown_id:
                out += self._careful(b"".join(run))
                run = []
            else:
                run.append(self.surface[i])
        out += self._careful(b"".join(run))
        return "".join(out)[cut:]

    @staticmethod
    def _careful(raw: bytes):
        k = 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    yield raw[k:k + n].decode()
                except UnicodeDecodeError:
                    continue
                k += n
                break
            else:
                yield "�"
                k += 1


@functools.lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every text, encoded and decoded.

    A null text counts as empty: one end id, and an empty decoded text. A null id is
    carried along; equal rows give equal rows; an empty table gives an empty one.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = model(model_path)
        ids = [own.encode(t) for t in texts(batch)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
             pa.array([own.decode(i) for i in ids], pa.string())],
            ["doc_id", "ids", "decoded"])

    return map_batches(thin(docs, "doc_id", "text"), work,
                       "doc_id bigint, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """As ``encode_documents``, with counts and digests of the ids and decoded texts;
    the ids themselves come last if asked for."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = model(model_path)
        counts, coded, decoded, kept = [], [], [], []
        for text in texts(batch):
            ids = own.encode(text)
            counts.append(len(ids))
            coded.append(hashlib.sha256(
                " ".join(map(own.id_text.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            if with_ids:
                kept.append(pa.array(ids, pa.int32()))
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()),
                   pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            ends = pa.array([0, *itertools.accumulate(counts)], pa.int32())
            flat = pa.concat_arrays(kept) if kept else pa.array([], pa.int32())
            columns, names = [*columns, pa.ListArray.from_arrays(ends, flat)], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(
        thin(docs, "doc_id", "text"), work,
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
        + ", ids array<int>" * with_ids)
