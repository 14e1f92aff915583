"""The best postings of many profiles, found for a block of profiles at once.

A task meets a block of profiles with batches of postings that stand in blocks of alike ones
(:mod:`postmatch.operators.pruned`). A block of postings is bounded for all profiles together, then
scored for the profiles whose least wanted score its bound reaches: first the semantic signal, the keyword
signal only where a full one would do, and the exact score only of pairs that still may be among
the best. What a profile's text holds of the postings' terms is known beforehand, so no
text is searched here. Scores are made by the formulas and in the order of
:mod:`postmatch.operators.measure`, the same to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from postmatch import fixed
from postmatch.operators.measure import KIND, Block, Kinds, bounded, numbers, percentage, whole

#: What rounding of the parts and of the score can add to a score, generously.
SLACK = 0.05
#: Kinds or rows times profiles, and terms times profiles, that are in memory at once, about.
MOST_CELLS = 1 << 21
_PLAIN = ("skill_match", "title_match", "experience_match", "education_bonus")


class Index:
    """Which profiles of a block have a term, from the profiles' lists of terms."""

    def __init__(self, lists: pa.ListArray):
        self.width = len(lists)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.terms = coded.dictionary
        self.whose = np.repeat(np.arange(self.width), sizes)[np.argsort(codes, kind="stable")]
        self.counts = np.bincount(codes, minlength=len(self.terms))
        self.starts = np.cumsum(self.counts) - self.counts
        step = max(1, MOST_CELLS // max(1, self.width))
        rows = [self._rows(at, min(len(self.terms), at + step)) for at in range(0, len(self.terms), step)]
        #: A bit for each profile, and one row more for terms that none has.
        self.bits = np.concatenate([*rows, np.zeros((1, (self.width + 7) // 8), np.uint8)])

    def _rows(self, begin: int, end: int) -> np.ndarray:
        out = np.zeros((end - begin, self.width), dtype=bool)
        held = slice(self.starts[begin], self.starts[end - 1] + self.counts[end - 1])
        out[np.repeat(np.arange(end - begin), self.counts[begin:end]), self.whose[held]] = True
        return np.packbits(out, axis=1)

    def codes(self, terms: pa.Array) -> np.ndarray:
        """The number of each term here, -1 for those that no profile has."""
        return pc.index_in(terms, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False)

    def rows(self, codes: np.ndarray, whose: np.ndarray | slice = slice(None)) -> np.ndarray:
        """1 where a profile has a term, terms by profiles."""
        return np.unpackbits(self.bits[codes], axis=1, count=self.width)[:, whose].astype(float)


class Seekers(Block):
    """A block of profiles that look for their best postings."""

    def __init__(self, profiles: pa.StructArray):
        self.rows = pc.struct_field(profiles, "_row")
        self.ids = pc.struct_field(profiles, "profile_id")
        self.has_text = pc.struct_field(profiles, "has_text").to_numpy(zero_copy_only=False).astype(bool)
        self._read(profiles)
        self.known = Index(pc.struct_field(profiles, "known"))
        self.own = Index(pc.struct_field(profiles, "skills"))
        self.least = np.nan_to_num(numbers(pc.struct_field(profiles, "_least")), nan=-np.inf)
        first = pc.struct_field(profiles, "_first")
        whose = np.repeat(np.arange(len(self)), first.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        blocks = first.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(blocks, kind="stable")
        found, starts = np.unique(blocks[order], return_index=True)
        #: The profiles that each block of postings is scored for first.
        self.first = dict(zip(found.tolist(), np.split(whose[order], starts[1:]), strict=False))
        self.comparable = self.has_text & self.has_vector & (self.norm != 0)
        unit = np.divide(self.vectors, self.norm, out=np.zeros_like(self.vectors), where=self.comparable)
        #: By profile, so that those of some profiles are copied row by row.
        self.unit = np.ascontiguousarray(unit.T)
        self.by_profile = np.ascontiguousarray(self.vectors.T)
        self.inverse = np.divide(1.0, self.norm, out=np.zeros(len(self)), where=self.comparable)

    def holders(self, terms: list[str]) -> np.ndarray:
        out = self.known.bits[self.known.codes(pa.array(terms, pa.string()))]
        out[[k for k, term in enumerate(terms) if term == ""]] = 255
        return out

    def skilled(self, terms: list[str]) -> np.ndarray:
        return self.own.bits[self.own.codes(pa.array(terms, pa.string()))]

    def kinds(self, weights: Mapping[str, float], has_text, *columns) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The signals of kinds of postings and what they add up to, kinds by profiles."""
        parts = self.plain(Kinds(self, *columns), np.arange(len(has_text)))
        empty = ~has_text.fill_null(False).to_numpy(zero_copy_only=False)
        for name in _PLAIN:
            parts[name][empty] = 0.0
        return parts, sum(parts[name] * float(weights[name]) for name in _PLAIN)

    def nearest(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The most that the semantic signal can be with unit vectors between these, blocks by profiles."""
        most = high @ np.maximum(self.unit, 0).T + low @ np.minimum(self.unit, 0).T
        # A vector that is not finite bounds nothing.
        return np.where(np.isfinite(most), np.clip(most * 100, 0, 100), 100.0) * self.comparable


class Best:
    """The best ``k`` postings so far of each profile of a block."""

    def __init__(self, block: Seekers, k: int):
        self.block, self.k, self.parts, self.fresh = block, k, [], 0

    def add(self, whose: np.ndarray, postings: pa.Array, scores: np.ndarray) -> None:
        self.parts.append(pa.table({"whose": pa.array(whose), "posting": postings, "score": pa.array(scores)}))
        self.fresh += len(whose)
        if self.fresh > max(len(self.block), 1 << 12):
            self.cut()

    def cut(self) -> pa.Table | None:
        if not self.parts:
            return None
        table = pa.concat_tables(self.parts)
        table = table.take(pc.sort_indices(
            table, sort_keys=[("whose", "ascending"), ("score", "descending"), ("posting", "ascending")],
            null_placement="at_start")).combine_chunks()
        whose = table["whose"].to_numpy()
        sizes = np.bincount(whose, minlength=len(self.block))
        starts = np.cumsum(sizes) - sizes
        kept = table.filter(pa.array(np.arange(len(whose)) - starts[whose] < self.k))
        full = np.flatnonzero(sizes >= self.k)
        kth = table["score"].to_numpy()[starts[full] + self.k - 1]
        self.block.least[full] = np.maximum(self.block.least[full], kth)
        self.parts, self.fresh = [kept], 0
        return kept


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Seekers, bool, pa.RecordBatch]]:
    """Rows with the block of profiles they meet and whether it is new: a row that brings one
    stands first in its task, and null in the rows after it."""
    block = None
    for batch in batches:
        sent = batch.column("_profiles")
        begins = np.flatnonzero(sent.is_valid().to_numpy(zero_copy_only=False)).tolist()
        for begin, end in pairwise(sorted({0, *begins, len(sent)})):
            new = begin in begins
            if new:
                block = Seekers(sent.slice(begin, 1).flatten())
            yield block, new, batch.slice(begin, end - begin)


def _steps(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, size) for at in range(0, len(batch), size))


def best_blocks(weights: Mapping[str, float], k: int) -> Callable:
    """``_row, _block, _rows, _bound``: of a task's blocks of postings those with each profile's
    highest bounds, as many as hold ``k`` postings, from rows of block summaries."""
    weights = dict(weights)

    def bound_of(block: Seekers, rows: pa.RecordBatch) -> np.ndarray:
        kinds = rows.column("_kinds")
        sizes = kinds.value_lengths().to_numpy(zero_copy_only=False)
        flat = kinds.flatten()
        names = pc.struct_field(flat, "_kind").dictionary_encode()
        codes = names.indices.to_numpy(zero_copy_only=False)
        once = flat.take(pa.array(np.unique(codes, return_index=True)[1]))
        _, total = block.kinds(weights, *(pc.struct_field(once, n) for n in KIND))
        known = np.maximum.reduceat(total[codes], np.cumsum(sizes) - sizes, axis=0)
        near = block.nearest(_filled(block, rows.column("_high")), _filled(block, rows.column("_low")))
        return known + weights["semantic_match"] * near + 100 * weights["keyword_match"] + SLACK

    def listed(block: Seekers, bounds: np.ndarray, ids: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(-bounds, axis=0, kind="stable")
        before = np.cumsum(held[order], axis=0) - held[order]
        turn, whose = np.nonzero(before < k)
        at = order[turn, whose]
        return pa.RecordBatch.from_arrays(
            [block.rows.take(pa.array(whose)), pa.array(ids[at]), pa.array(held[at]), pa.array(bounds[at, whose])],
            ["_row", "_block", "_rows", "_bound"])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, batch in blocks_of(batches):
            # A block of postings has several kinds, so fewer rows are met at once.
            for rows in _steps(batch, max(1, MOST_CELLS // 8 // max(1, len(block)))):
                yield listed(block, bound_of(block, rows), rows.column("_block").to_numpy(), rows.column("_rows").to_numpy())

    return ranked


def _filled(block: Seekers, vectors: pa.Array) -> np.ndarray:
    """Bounds of vectors as rows, 0 where no vector has an entry."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    width = len(block.held)
    dense = np.zeros((len(vectors), max(width, int(sizes.max(initial=0)))))
    flat = numbers(vectors.flatten())
    row = np.repeat(np.arange(len(sizes)), sizes)
    dense[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return dense[:, :width]


class Keywords:
    """The keywords of a batch of postings that any profile's text of a block has, coded once a
    batch: a look at the profiles' terms costs as much as all of them."""

    def __init__(self, block: Seekers, lists: pa.ListArray):
        flat = lists.flatten()
        coded = pc.struct_field(flat, "token").dictionary_encode()
        codes = block.known.codes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        held = codes >= 0
        #: Row, term and weight of each, by row.
        self.all = (np.repeat(np.arange(len(sizes)), sizes)[held], codes[held],
                    numbers(pc.struct_field(flat, "weight"))[held])

    def of(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of some rows, which count from 0."""
        row, codes, weights = self.all
        own = slice(*np.searchsorted(row, [begin, end]))
        return row[own] - begin, codes[own], weights[own]


class Rows:
    """Some postings that meet a block of profiles."""

    def __init__(self, block: Seekers, weights: Mapping[str, float], rows: pa.RecordBatch,
                 keywords: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.block, self.weights = block, weights
        self.ids = rows.column("posting_id")
        self.has_text = rows.column("_has_text").fill_null(False).to_numpy(zero_copy_only=False)
        names = rows.column("_kind").dictionary_encode()
        self.kind = names.indices.to_numpy(zero_copy_only=False)
        once = rows.take(pa.array(np.unique(self.kind, return_index=True)[1]))
        self.parts, self.plain = block.kinds(weights, *(once.column(n) for n in KIND))
        vector = rows.column("_vector")
        self.vectors = block.dense(vector)
        self.exact = block.whole and whole(self.vectors)
        self.norm = numbers(rows.column("_norm"))
        self.comparable = vector.is_valid().to_numpy(zero_copy_only=False) & self.has_text
        usable = self.comparable & (self.norm != 0)
        self.unit = np.divide(self.vectors, self.norm[:, None], out=np.zeros_like(self.vectors), where=usable[:, None])
        self.inverse = np.divide(1.0, self.norm, out=np.zeros(len(usable)), where=usable)
        self.keyword = keywords
        self.weight = numbers(rows.column("_weight"))
        blocks = rows.column("_block").to_numpy()
        self.begins = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1))
        self.blocks = blocks[self.begins]
        unit = np.where(np.isnan(self.vectors), 0.0, self.unit)
        self.near = block.nearest(np.maximum.reduceat(unit, self.begins), np.minimum.reduceat(unit, self.begins))

    def runs(self) -> Iterator[tuple[int, int, int]]:
        """Number, first row and row after the last of each block of postings."""
        ends = [*self.begins[1:].tolist(), len(self.kind)]
        return zip(range(len(ends)), self.begins.tolist(), ends, strict=True)

    def bound(self, number: int, begin: int, end: int) -> np.ndarray:
        """What any of a block's postings can score, for each profile."""
        known = self.plain[np.unique(self.kind[begin:end])].max(axis=0)
        return known + self.weights["semantic_match"] * self.near[number] + 100 * self.weights["keyword_match"] + SLACK

    def found(self, begin: int, end: int, whose: np.ndarray) -> np.ndarray:
        """Weight of the keywords that a profile's text has, rows by profiles."""
        at, codes, weights = self.keyword
        cut = slice(*np.searchsorted(at, [begin, end]))
        terms, place = np.unique(codes[cut], return_inverse=True)
        out = np.zeros((end - begin, len(whose)))
        step = max(1, MOST_CELLS // max(1, len(self.block)))
        for low in range(0, len(terms), step):
            own = (place >= low) & (place < low + step)
            table = np.zeros((end - begin, min(step, len(terms) - low)))
            np.add.at(table, (at[cut][own] - begin, place[own] - low), weights[cut][own])
            out += table @ self.block.known.rows(terms[low:low + step], whose)
        return out

    def semantic(self, row: np.ndarray, whose: np.ndarray) -> np.ndarray:
        """The semantic signal of pairs, its products added from left to right."""
        block, total = self.block, np.zeros(len(row))
        for d in range(self.vectors.shape[1]):
            held = block.held[d, whose]
            total[held] += self.vectors[row[held], d] * block.vectors[d, whose[held]]
        return self.cosine(total, row, whose)

    def cosine(self, dots: np.ndarray, row: np.ndarray, whose: np.ndarray) -> np.ndarray:
        product = self.block.norm[whose] * self.norm[row]
        value = bounded(np.divide(dots, product, out=np.full(product.shape, np.nan), where=product != 0) * 100)
        return np.where(self.comparable[row] & (self.block.has_vector & self.block.has_text)[whose], value, 0.0)

    def scored(self, begin: int, end: int, whose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, profile and score of the pairs of a block that reach a profile's least."""
        block, weights = self.block, self.weights
        least = block.least[whose] - SLACK
        most = weights["keyword_match"] * 100.0
        if self.exact:
            dots = self.vectors[begin:end] @ block.by_profile[whose].T
            near = dots * self.inverse[begin:end, None] * (block.inverse[whose] * 100)
        else:
            near = self.unit[begin:end] @ block.unit[whose].T * 100
            near[~np.isfinite(near)] = 100.0
        known = self.plain[self.kind[begin:end]][:, whose] + np.maximum(near, 0) * weights["semantic_match"]
        some = np.flatnonzero((known + most >= least).any(axis=0))
        if not len(some):
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        known, whose, least = known[:, some], whose[some], least[some]
        found = self.found(begin, end, whose)
        total = np.where((self.weight[begin:end] > 0) & self.has_text[begin:end], self.weight[begin:end], np.inf)[:, None]
        row, at = np.nonzero(known + found / total * most >= least)
        found, inside, whose = found[row, at], (row, some[at]), whose[at]
        row = row + begin
        semantic = self.cosine(dots[inside], row, whose) if self.exact else self.semantic(row, whose)
        kind = self.kind[row]
        parts = {name: self.parts[name][kind, whose] for name in _PLAIN} | {
            "semantic_match": semantic,
            "keyword_match": np.where(self.has_text[row], percentage(found, self.weight[row]), 0.0)}
        score = 0.0
        for name in fixed.WEIGHTS:
            score = score + parts[name] * float(weights[name])
        score = bounded(score)
        kept = score >= block.least[whose]
        return row[kept], whose[kept], score[kept]


def best_pairs(weights: Mapping[str, float], k: int, first: bool) -> Callable:
    """``_row, profile_id, posting_id, ats_score``: the best ``k`` of a task's postings for each
    profile that reach its ``_least`` score, among the blocks it meets ``first`` or among all
    others whose bound reaches that score."""
    weights = dict(weights)

    def listed(best: Best | None) -> Iterator[pa.RecordBatch]:
        table = best.cut() if best is not None else None
        for part in table.to_batches(max_chunksize=1 << 14) if table is not None else ():
            block, whose = best.block, part.column("whose")
            yield pa.RecordBatch.from_arrays(
                [block.rows.take(whose), block.ids.take(whose), part.column("posting"), part.column("score")],
                ["_row", "profile_id", "posting_id", "ats_score"])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for block, new, batch in blocks_of(batches):
            if new:
                yield from listed(best)
                best = Best(block, k)
            keywords, size = Keywords(block, batch.column("_keywords")), max(1, MOST_CELLS // max(1, len(block)))
            for at, part in zip(range(0, len(batch), size), _steps(batch, size), strict=True):
                rows = Rows(block, weights, part, keywords.of(at, at + len(part)))
                for number, begin, end in rows.runs():
                    whose = block.first.get(int(rows.blocks[number]), np.empty(0, int))
                    if not first:
                        wanted = rows.bound(number, begin, end) >= block.least
                        wanted[whose] = False
                        whose = np.flatnonzero(wanted)
                    if len(whose):
                        row, of, score = rows.scored(begin, end, whose)
                        best.add(of, rows.ids.take(pa.array(row)), score)
        yield from listed(best)

    return ranked
