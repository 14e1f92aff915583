"""The signals of many profiles for each posting, measured for a block of profiles at once.

Pair by pair every signal is an expression over both sides, which looks for each keyword
in each profile's text anew. Here a task meets a block of profiles with batches of postings:
a batch's distinct terms are looked up once among the stretches of the profiles' distinct words,
what depends on a posting's kind alone is made once a kind, and the signals are sums over
arrays, by the formulas and in the order of :mod:`postmatch.operators.score`. Numbers that are not
whole are added from left to right as there, so each signal is the same to the last bit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from postmatch import fixed

#: Posting features that the signals are made of.
USED = ("_has_text", "_skills", "_keywords", "_weight", "_title_words", "_years", "_education", "_vector", "_norm")
SIGNALS = (*fixed.WEIGHTS, "ats_score")
#: What makes a kind of posting.
KIND = ("_has_text", "_skills", "_title_words", "_years", "_education")
#: Pairs and sums that are in memory at once, about.
MOST_PAIRS = 1 << 18
MOST_SUMS = 1 << 22
#: Terms of at most so many characters are looked up among the stretches of a text's words,
#: where no word is longer than LONGEST_WORD; the others in the text.
LONGEST_TERM = 24
LONGEST_WORD = 512


def bounded(value: np.ndarray) -> np.ndarray:
    number = np.where(np.isnan(value), 0.0, value)
    return np.rint(np.maximum(0.0, np.minimum(100.0, number)) * 100) / 100


def percentage(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return bounded(np.divide(part, whole, out=np.full(np.broadcast(part, whole).shape, np.nan), where=whole != 0) * 100)


def numbers(values: pa.Array) -> np.ndarray:
    """Doubles, NaN for null."""
    return values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


class Lists:
    """A column of lists of terms, each with a weight, as codes of its distinct terms."""

    def __init__(self, lists: pa.Array, weighted: bool = False):
        flat = lists.flatten()
        terms = pc.struct_field(flat, "token") if weighted else flat
        coded = terms.dictionary_encode()
        self.terms = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.weights = numbers(pc.struct_field(flat, "weight")) if weighted else None
        self.sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def sums(self, held: np.ndarray, width: int, rows: np.ndarray) -> np.ndarray:
        """For each of some rows and each profile the weight of the row's terms that the profile
        has. ``held`` has a bit for each of ``width`` profiles, by term."""
        out = np.zeros((len(rows), width))
        begins, sizes = self.begins[rows], self.sizes[rows]
        most, step = int(sizes.max(initial=0)), max(1, MOST_SUMS // max(1, out.size))
        for low in range(0, most, step):
            # The first terms of all rows, then their second ones, and so on.
            turns = [np.flatnonzero(sizes > at) for at in range(low, min(low + step, most))]
            places = [begins[turn] + at for at, turn in enumerate(turns, low)]
            terms, known = np.unique(self.codes[np.concatenate(places)], return_inverse=True)
            member = np.unpackbits(held[terms], axis=1, count=width).astype(float)
            begin = 0
            for turn, place in zip(turns, places, strict=True):
                values = member[known[begin:begin + len(turn)]]
                begin += len(turn)
                if self.weights is not None:
                    values *= self.weights[place, None]
                if len(turn) == len(out):
                    out += values
                else:
                    out[turn] += values
        return out


class Block:
    """A block of profiles, ready to meet postings."""

    def __init__(self, profiles: pa.StructArray):
        self.texts = pc.struct_field(profiles, "text").to_pylist()
        self.has_text = np.array([bool(t) for t in self.texts], dtype=bool)
        each = [frozenset((t or "").split(" ")) for t in self.texts]
        #: Profiles with a word too long to be cut into all its stretches.
        self.long = [p for p, words in enumerate(each) if any(len(w) > LONGEST_WORD for w in words)]
        numbered: dict[str, int] = {}
        found = [(numbered.setdefault(w, len(numbered)), p) for p, words in enumerate(each) for w in words
                 if len(w) <= LONGEST_WORD]
        self.words = list(numbered)
        #: A bit for each profile that has a word.
        self.having = packed(np.array(found, dtype=np.int64).reshape(-1, 2), len(numbered), len(each))
        self.stretches: dict[int, tuple[pa.Array, np.ndarray]] = {}
        self._read(profiles)

    def _read(self, profiles: pa.StructArray) -> None:
        """All but the texts."""
        self.skills = [frozenset(s or ()) for s in pc.struct_field(profiles, "skills").to_pylist()]
        self.years = numbers(pc.struct_field(profiles, "years"))
        self.norm = numbers(pc.struct_field(profiles, "norm"))
        vectors = pc.struct_field(profiles, "vector")
        self.has_vector = vectors.is_valid().to_numpy(zero_copy_only=False)
        sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        entries = vectors.flatten()
        at = pc.struct_field(entries, "at").to_numpy(zero_copy_only=False).astype(np.int64)
        self.held = np.zeros((int(at.max()) + 1 if len(at) else 0, len(self)), dtype=bool)
        self.vectors = np.zeros(self.held.shape)
        whose = np.repeat(np.arange(len(self)), sizes)
        self.held[at, whose] = True
        self.vectors[at, whose] = numbers(pc.struct_field(entries, "x"))
        self.whole = whole(self.vectors)

    def __len__(self) -> int:
        return len(self.has_text)

    def _of_length(self, n: int) -> tuple[pa.Array, np.ndarray]:
        """The stretches of ``n`` characters of all words, and the profiles that have each."""
        if n not in self.stretches:
            coded = pa.array([w[i:i + n] for w in self.words for i in range(len(w) - n + 1)], pa.string()).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            whose = np.repeat(np.arange(len(self.words)), [max(0, len(w) - n + 1) for w in self.words])
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            having = np.zeros((len(starts), self.having.shape[1]), np.uint8)
            # No more words are gathered at once than there are sums; a stretch may be in any number of them.
            for at in range(0, len(order), MOST_SUMS):
                own = slice(*np.searchsorted(starts, [at, at + MOST_SUMS]))
                begins, first = starts[own] - at, max(0, own.start - 1)
                if not len(begins) or begins[0]:
                    begins, own = np.concatenate([[0], begins]), slice(first, own.stop)
                rows = self.having[whose[order[at:at + MOST_SUMS]]]
                having[own] |= np.bitwise_or.reduceat(rows, begins, axis=0)
            self.stretches[n] = coded.dictionary, having
        return self.stretches[n]

    def holders(self, terms: list[str]) -> np.ndarray:
        """A bit for each profile whose text holds a term, by term."""
        out = np.zeros((len(terms), self.having.shape[1]), np.uint8)
        by_length = defaultdict(list)
        for k, term in enumerate(terms):
            by_length[len(term) if 0 < len(term) <= LONGEST_TERM and " " not in term else 0].append(k)
        for n, group in by_length.items():
            sought = [terms[k] for k in group]
            if n:
                known, having = self._of_length(n)
                at = pc.index_in(pa.array(sought, pa.string()), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                out[np.array(group)[at >= 0]] = having[at[at >= 0]]
            for p in self.long if n else range(len(self)):
                text = self.texts[p]
                out[[k for k, term in zip(group, sought, strict=True) if text is not None and term in text], p >> 3] |= 128 >> (p & 7)
        return out

    def contained(self, terms: list[str]) -> np.ndarray:
        """Whether each profile's text holds each term."""
        return np.unpackbits(self.holders(terms), axis=1, count=len(self)).astype(float)

    def skilled(self, terms: list[str]) -> np.ndarray:
        """A bit for each profile with a skill, by skill."""
        return np.packbits(np.array([[t in s for s in self.skills] for t in terms], dtype=bool).reshape(
            len(terms), len(self)), axis=1)

    def dense(self, vectors: pa.Array) -> np.ndarray:
        """Vectors as rows of as many entries as the profiles have, NaN where there is none."""
        sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        dense = np.full((len(vectors), max(int(sizes.max()) if len(sizes) else 0, len(self.held))), np.nan)
        flat = numbers(vectors.flatten())
        if len(flat) and (sizes == dense.shape[1]).all():
            dense = flat.reshape(dense.shape)
        else:
            ends = np.cumsum(sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            dense[row, np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
        return dense[:, :len(self.held)]

    def dots(self, vectors: pa.Array) -> np.ndarray:
        dense = self.dense(vectors)
        if self.whole and whole(dense):
            return dense @ self.vectors
        out = np.zeros((len(vectors), len(self)))
        for d in np.flatnonzero(self.held.any(axis=1)):
            whose = np.flatnonzero(self.held[d])
            out[:, whose] += dense[:, d, None] * self.vectors[d, whose]
        return out

    def plain(self, kinds: Kinds, rows: np.ndarray) -> dict[str, np.ndarray]:
        """The signals that a posting's kind has with each profile, some kinds by profiles."""
        required = kinds.years[rows, None]
        share = bounded(np.divide(
            self.years, required, out=np.full((len(required), len(self)), np.nan), where=required != 0) * 100)

        def found(name: str) -> np.ndarray:
            lists, held = kinds.terms[name]
            return percentage(lists.sums(held, len(self), rows), lists.sizes[rows, None].astype(float))

        return {
            "skill_match": found("_skills"),
            "title_match": found("_title_words"),
            "experience_match": np.where(np.isnan(required) | (self.years >= required), 100.0, share),
            "education_bonus": np.where(
                kinds.terms["_education"][0].sizes[rows, None] == 0, 100.0, found("_education")),
        }


class Kinds:
    """Kinds of postings, their terms looked up in a block of profiles."""

    def __init__(self, block: Block, skills: pa.Array, title_words: pa.Array, years: pa.Array, education: pa.Array):
        self.years = numbers(years)
        self.terms = {}
        for name, lists, look in (("_skills", Lists(skills), block.skilled), ("_title_words", Lists(title_words), block.holders),
                                  ("_education", Lists(education), block.holders)):
            self.terms[name] = lists, look(lists.terms)


class Meeting:
    """A block of profiles and a batch of postings."""

    def __init__(self, weights: Mapping[str, float], block: Block, kind, has_text, skills, keywords, weight, title_words,
                 years, education, vector, norm):
        self.weights, self.block = weights, block
        self.empty = ~has_text.fill_null(False).to_numpy(zero_copy_only=False)
        self.kind = kind.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        once = pa.array(np.unique(self.kind, return_index=True)[1])
        self.kinds = Kinds(block, *(c.take(once) for c in (skills, title_words, years, education)))
        self.keywords = Lists(keywords, True)
        self.held = block.holders(self.keywords.terms)
        self.weight, self.vector, self.norm = numbers(weight), vector, numbers(norm)

    def __len__(self) -> int:
        return len(self.kind)

    def measured(self, begin: int, end: int) -> dict[str, np.ndarray]:
        """Every signal, some postings by profiles."""
        block, vector = self.block, self.vector.slice(begin, end - begin)
        kinds, kind = np.unique(self.kind[begin:end], return_inverse=True)
        parts = {name: value[kind] for name, value in block.plain(self.kinds, kinds).items()}
        product = block.norm * self.norm[begin:end, None]
        semantic = bounded(np.divide(block.dots(vector), product, out=np.full(product.shape, np.nan), where=product != 0) * 100)
        semantic[~vector.is_valid().to_numpy(zero_copy_only=False)] = 0.0
        semantic[:, ~(block.has_vector & block.has_text)] = 0.0
        parts["semantic_match"] = semantic
        parts["keyword_match"] = percentage(
            self.keywords.sums(self.held, len(block), np.arange(begin, end)), self.weight[begin:end, None])
        total = 0.0
        for name in fixed.WEIGHTS:
            parts[name][self.empty[begin:end]] = 0.0
            total = total + parts[name] * float(self.weights[name])
        return parts | {"ats_score": bounded(total)}


def packed(places: np.ndarray, rows: int, width: int) -> np.ndarray:
    """A bit for each of ``width`` columns, set at some places of row and column."""
    out = np.zeros((rows, (width + 7) // 8), np.uint8)
    np.bitwise_or.at(out, (places[:, 0], places[:, 1] >> 3), (128 >> (places[:, 1] & 7)).astype(np.uint8))
    return out


def whole(values: np.ndarray) -> bool:
    """Whether all sums of products are whole numbers that a double holds."""
    return bool(np.isfinite(values).all() and (np.abs(values) <= 1 << 20).all() and (values == np.rint(values)).all())


def block_signals(weights: Mapping[str, float], profiles: Column) -> Column:
    """A struct with an array for each signal, of every profile of a block in the block's order.

    ``profiles`` is the block in a task's first row and null in the rows after it, so that a
    block is sent once a task and not once a row.
    """
    weights = dict(weights)

    @F.arrow_udf(f"struct<{', '.join(f'{name}: array<double>' for name in SIGNALS)}>")
    def signals(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        block = None
        for sent, *columns in batches:
            begins = np.flatnonzero(sent.is_valid().to_numpy(zero_copy_only=False)).tolist()
            for begin, end in zip([0, *begins], [*begins, len(sent)], strict=True):
                if begin == end:
                    continue
                if begin in begins:
                    block = Block(sent.slice(begin, 1).flatten())
                met = Meeting(weights, block, *(c.slice(begin, end - begin) for c in columns))
                step = max(1, MOST_PAIRS // max(1, len(block)))
                for at in range(0, len(met), step):
                    rows = min(step, len(met) - at)
                    parts = met.measured(at, at + rows)
                    ends = pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(len(block)))
                    yield pa.StructArray.from_arrays(
                        [pa.ListArray.from_arrays(ends, pa.array(parts[n].ravel())) for n in SIGNALS], list(SIGNALS))

    # Not deterministic for the optimizer: a filter of postings passed below could drop the row with the block.
    return signals.asNondeterministic()(profiles, F.to_json(F.struct(*KIND)), *map(F.col, USED))
