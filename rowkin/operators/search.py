"""Exact top-k cosine search in blocks: grams of texts in packed chunks, and the best candidates of a chunk's texts in a block.

Scores are bounded first: for each part a product of matrices over a block's weightiest grams, plus Cauchy-Schwarz for all others.
Equal parts of texts are multiplied once. A block's texts are met by the values of one part: a value is opened only if its bound and
the best bounds of the other parts reach a text's k-th score, and the part is the one that opens the fewest pairs for the text. Only
pairs whose own bound reaches that score are summed in full, in double precision and in the order of their grams.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

BASE = 0x110000
#: Grams of so many parts fit a long together.
MOST_PARTS = 6
CHUNK_ROWS, CHUNK_CHARS, HELD_CHARS = 2048, 4 << 20, 16 << 20
#: Source 1 texts of a block, about; grams of a block in the matrices; texts that meet a block at once, and in one product.
BLOCK_ROWS, COLUMNS, PRODUCT_ROWS, PRODUCTS = 8192, 1024, 256, 8
#: Texts of a block that give a first k-th score; bytes of a task's blocks that are kept from one chunk to the next.
FIRST_ROWS, KEPT_BYTES = 2048, 112 << 20
#: Source 1 texts that one task goes through for its chunks, about; a text's k-th score is known from one block to the next.
TASK_ROWS = 1 << 17
CHUNK_SCHEMA = "country string, n_fit long, n_s int, n_r int, grams array<struct<gram: long, df: long>>, ours binary, theirs binary"
FOUND_SCHEMA = "country string, text_ binary, cand_text_ binary, score double, cosines array<double>"


def gram_counts(texts: list[str], part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct grams, and row, gram number, count of each text's grams, by row and gram) as ``blocking.trigrams`` has them."""
    points = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), np.uint32)
    rows = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    used = np.zeros(BASE, bool)
    used[points] = True
    letters = np.flatnonzero(used)
    number = np.zeros(BASE, np.int64)
    number[letters] = np.arange(len(letters))
    at, n = number[points], len(letters)
    middle = np.flatnonzero(points != 32)
    if not len(middle):
        return np.zeros(0, np.int64), *(np.zeros(0, np.int64) for _ in range(3))
    codes, rows = (at[middle - 1] * n + at[middle]) * n + at[middle + 1], rows[middle]
    if n**3 <= 1 << 24:
        there = np.zeros(n**3, bool)
        there[codes] = True
        distinct = np.flatnonzero(there)
        place = np.zeros(n**3, np.int64)
        place[distinct] = np.arange(len(distinct))
        codes = place[codes]
    else:
        distinct, codes = np.unique(codes, return_inverse=True)
    grams = ((part * BASE + letters[distinct // (n * n)]) * BASE + letters[distinct // n % n]) * BASE + letters[distinct % n]
    width, found = len(distinct), []
    step = max(1, (1 << 21) // width)
    for lo in range(0, len(texts), step):
        a, b = np.searchsorted(rows, [lo, lo + step])
        cells, tf = np.unique((rows[a:b] - lo) * width + codes[a:b], return_counts=True) if (b - a) * 8 < width else counted((rows[a:b] - lo) * width + codes[a:b])
        found.append((cells // width + lo, cells % width, tf))
    return grams, *(np.concatenate(x) for x in zip(*found, strict=True))


def counted(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(cells)
    held = np.flatnonzero(counts)
    return held, counts[held]


def narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def part_hashes(texts: list[str]) -> np.ndarray:
    known = {t: int.from_bytes(hashlib.md5(t.encode(errors="surrogatepass")).digest()[:8], "little") for t in set(texts)}
    return np.array([known[t] for t in texts], np.uint64)


def packed(keep: np.ndarray, texts: list[bytes], ids: list, same: np.ndarray, rows: np.ndarray, grams: np.ndarray, tf: np.ndarray) -> bytes:
    """The kept texts' keys, smallest ids, 64-bit hashes of parts (bounds alone rest on them) and gram counts."""
    which, inside = np.flatnonzero(keep), keep[rows]
    sizes = np.bincount(rows, minlength=len(keep))[which]
    return pickle.dumps(([texts[i] for i in which], [ids[i] for i in which], same[which], narrow(sizes), narrow(grams[inside]), narrow(tf[inside])), protocol=5)


def chunk(country: str, rows: list[tuple]) -> dict:
    """A row of CHUNK_SCHEMA from (text_, first, n_s, n_r, n_fit, *parts) of one country's texts."""
    keys, ids, n_s, n_r, fit, *parts = zip(*rows, strict=True)
    found, grams, before = [], [], 0
    for p, texts in enumerate(parts):
        own, *cells = gram_counts(list(texts), p)
        found.append((cells[0], cells[1] + before, cells[2]))
        grams.append(own)
        before += len(own)
    row, gram, tf = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(row, kind="stable")
    row, gram, tf = row[order], gram[order], tf[order]
    n_s, n_r, fit = (np.array(x, np.int64) for x in (n_s, n_r, fit))
    dfs = np.zeros(before, np.int64)
    np.add.at(dfs, gram, fit[row])
    same = np.stack([part_hashes(texts) for texts in parts], axis=1)
    sides = {name: packed(n > 0, keys, ids, same, row, gram, tf) for name, n in (("ours", n_s), ("theirs", n_r))}
    return {"country": country, "n_fit": int(fit.sum()), "n_s": int((n_s > 0).sum()), "n_r": int((n_r > 0).sum()), "grams": (np.concatenate(grams), dfs), **sides}


def chunked(parts: list[str]) -> Callable:
    """For mapInArrow: texts (country, text_, first, n_s, n_r, n_fit, parts) to CHUNK_SCHEMA."""
    types = {"country": pa.string(), "n_fit": pa.int64(), "n_s": pa.int32(), "n_r": pa.int32(), "ours": pa.binary(), "theirs": pa.binary()}
    names = ["country", "n_fit", "n_s", "n_r", "grams", "ours", "theirs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        chars: dict[str, int] = {}

        def out(country: str) -> pa.RecordBatch:
            made = chunk(country, held.pop(country))
            del chars[country]
            own = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in made["grams"]], ["gram", "df"])
            own = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            return pa.RecordBatch.from_arrays([own if c == "grams" else pa.array([made[c]], types[c]) for c in names], names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("country", "text_", "first", "n_s", "n_r", "n_fit", *parts)]
            for country, *row in zip(*columns, strict=True):
                size = sum(map(len, row[5:]))
                if country in held and (len(held[country]) == CHUNK_ROWS or chars[country] + size > CHUNK_CHARS):
                    yield out(country)
                held.setdefault(country, []).append(tuple(row))
                chars[country] = chars.get(country, 0) + size + 64
                if sum(chars.values()) > HELD_CHARS:
                    yield out(max(chars, key=chars.get))
        for country in list(held):
            yield out(country)

    return run


class Texts:
    """Weighted grams of packed texts, by text; a part's weights have length 1."""

    def __init__(self, pack: bytes, own: np.ndarray, known: np.ndarray, idf: np.ndarray, n_parts: int):
        """own: the chunk's grams; known: those with an inverse frequency, ascending, and idf: these frequencies."""
        self.keys, self.ids, self.same, sizes, number, tf = pickle.loads(pack)  # written by packed()
        n, gram = len(self.keys), own[number]
        row = np.repeat(np.arange(n), sizes)
        place = np.searchsorted(known, gram)
        kept = place < len(known)
        kept[kept] = known[place[kept]] == gram[kept]
        row, self.gram, place = row[kept], gram[kept], place[kept]
        weight = tf[kept] * idf[place]
        cell = row * n_parts + self.gram // BASE**3
        self.weight = weight / np.sqrt(np.bincount(cell, weight * weight, n * n_parts))[cell]
        self.row, self.start = row, np.searchsorted(row, np.arange(n + 1))


class Block:
    """Source 1 texts as columns: for each part, a matrix of its distinct values over their weightiest grams, and their length beside it."""

    def __init__(self, members: list[Texts]):
        self.keys, self.ids = [k for m in members for k in m.keys], [i for m in members for i in m.ids]
        starts = np.cumsum([0, *[len(m.keys) for m in members]])
        self.weight = np.concatenate([m.weight for m in members])
        row = np.concatenate([m.row + s for m, s in zip(members, starts, strict=False)])
        self.grams, self.column = np.unique(np.concatenate([m.gram for m in members]), return_inverse=True)
        self.column = self.column.astype(np.int32)
        self.start = np.searchsorted(row, np.arange(len(self.keys) + 1))
        self.part = (self.grams // BASE**3).astype(np.int64)
        mass = np.bincount(self.column, self.weight * self.weight, len(self.grams))
        chosen = np.sort(np.argsort(-mass, kind="stable")[:COLUMNS])
        same = np.concatenate([m.same for m in members])
        self.place, self.widths = np.full(len(self.grams), -1), []
        for p in range(same.shape[1]):
            own = chosen[self.part[chosen] == p]
            self.place[own] = np.arange(len(own))
            self.widths.append(len(own))
        self.sides = self.split(row, self.column, self.weight, same)
        #: For each part: texts ordered by their value, where each value's begin, and how many they are.
        self.groups = []
        for _, beside, value in self.sides:
            sizes = np.bincount(value, minlength=len(beside))
            self.groups.append((np.argsort(value, kind="stable"), np.cumsum(sizes) - sizes, sizes))
        self.bytes = sum(m.nbytes for m, *_ in self.sides) + self.weight.nbytes + self.column.nbytes + 256 * len(self.keys)

    def split(self, row: np.ndarray, column: np.ndarray, weight: np.ndarray, same: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each part: matrix and length beside it of the distinct values, and the value of each text."""
        place, part, out = self.place[column], self.part[column], []
        for p, width in enumerate(self.widths):
            _, first, value = np.unique(same[:, p], return_index=True, return_inverse=True)
            number = np.full(len(same), -1)
            number[first] = np.arange(len(first))
            own = (number[row] >= 0) & (part == p)
            r, at, w = number[row[own]], place[own], weight[own]
            inside = at >= 0
            matrix = np.zeros((len(first), width), np.float32)
            matrix[r[inside], at[inside]] = w[inside]
            out.append((matrix, np.sqrt(np.bincount(r[~inside], w[~inside] ** 2, len(first))).astype(np.float32), value))
        return out


def rounded(x: float, digits: int) -> float:
    """As SQL rounds: half up of the shortest decimal form."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def sums(block: Block, vector: np.ndarray, part: np.ndarray, those: np.ndarray, n_parts: int) -> np.ndarray:
    """Cosine of each part between a text, spread over the block's grams, and ``those`` texts of the block."""
    sizes = block.start[those + 1] - block.start[those]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) + np.repeat(block.start[those] - ends + sizes, sizes)
    column = block.column[at]
    cell = np.repeat(np.arange(len(those)), sizes) * n_parts + part[column]
    return np.bincount(cell, vector[column] * block.weight[at], len(those) * n_parts).reshape(-1, n_parts)


def improve(best: list[list], texts: Texts, block: Block, k: int, n_parts: int, digits: int) -> None:
    """Merge the block's texts into ``best``: for each of ``texts`` up to k of (-score, smallest id, key, cosines), in order."""
    n, m = len(texts.keys), len(block.keys)
    if not m or not len(block.grams):
        return
    column = np.searchsorted(block.grams, texts.gram)
    met = column < len(block.grams)
    met[met] = block.grams[column[met]] == texts.gram[met]
    row, column, weight = texts.row[met], column[met], texts.weight[met]
    start, part = np.searchsorted(row, np.arange(n + 1)), block.part
    # single precision: each product and sum is off by 2**-24 of itself at most, and lengths are at most n_parts together
    slack = n_parts * (sum(block.widths) + 16) * 2.0**-24
    near = n_parts * 2 * 10.0**-digits
    vector = np.zeros(len(block.grams))
    values = [v for _, _, v in block.sides]
    for begin in range(0, n, PRODUCT_ROWS * PRODUCTS):
        end = min(n, begin + PRODUCT_ROWS * PRODUCTS)
        a, b = start[begin], start[end]
        ours = block.split(row[a:b] - begin, column[a:b], weight[a:b], texts.same[begin:end])
        products = [x @ y.T for (x, _, _), (y, _, _) in zip(ours, block.sides, strict=True)]
        held = np.array([-best[i][-1][0] * n_parts if len(best[i]) == k else -1.0 for i in range(begin, end)])
        new = np.flatnonzero(held < 0)
        if m >= k:  # the k-th best of some texts is at most that of all
            some = min(m, max(k, FIRST_ROWS))
            for lo in range(0, len(new), PRODUCT_ROWS):
                those = new[lo : lo + PRODUCT_ROWS]
                low = sum(x[v[those]][:, w[:some]] for x, (_, _, v), w in zip(products, ours, values, strict=True))
                held[those] = np.maximum(-1.0, np.partition(low, some - k, axis=1)[:, some - k] - slack)
        for x, (_, u, _), (_, v, _) in zip(products, ours, block.sides, strict=True):
            if u.any() and v.any():
                x += np.outer(u, v)  # with what lies beside the matrices
        least = held - near
        most = [x.max(axis=1)[v].astype(float) for x, (_, _, v) in zip(products, ours, strict=True)]
        alive = np.flatnonzero(sum(most) >= least - 2 * slack)
        for lo in range(0, len(alive), PRODUCT_ROWS):
            rows = alive[lo : lo + PRODUCT_ROWS]
            need = least[rows] - sum(y[rows] for y in most) - 2 * slack
            open_ = [x[v[rows]] >= (need + y[rows]).astype(np.float32)[:, None] - np.float32(slack) for x, (_, _, v), y in zip(products, ours, most, strict=True)]
            pick = np.argmin([x @ g[2].astype(np.float32) for x, g in zip(open_, block.groups, strict=True)], axis=0) if n_parts > 1 else np.zeros(len(rows), int)
            lines, opened = [], []
            for p, (order, first, sizes) in enumerate(block.groups):
                line, group = np.nonzero(open_[p] & (pick == p)[:, None])
                count = sizes[group]
                ends = np.cumsum(count)
                lines.append(np.repeat(rows[line], count))
                opened.append(order[np.arange(count.sum()) + np.repeat(first[group] - ends + count, count)])
            line, columns = np.concatenate(lines), np.concatenate(opened)
            high = sum(x.ravel().take(v[line] * x.shape[1] + w[columns]) for x, (_, _, v), w in zip(products, ours, values, strict=True))
            kept = np.flatnonzero((high >= least[line] - 2 * slack) & (high > 0))
            kept = kept[np.argsort(line[kept], kind="stable")]
            line, columns, high = line[kept], columns[kept], high[kept]
            for i, lower, upper in zip(rows, np.searchsorted(line, rows), np.searchsorted(line, rows, "right"), strict=True):
                if lower == upper:
                    continue
                hit = slice(lower, upper)
                those, bound, floor, scores = columns[hit], high[hit], least[i], []
                own = slice(start[begin + i], start[begin + i + 1])
                vector[column[own]] = weight[own]
                order = np.argsort(-bound, kind="stable")
                those, bound = those[order], bound[order]
                at, step = 0, k
                while at < len(those) and bound[at] >= floor - 2 * slack:
                    scores.append(sums(block, vector, part, those[at : at + step], n_parts))
                    at, step = at + step, step * 4
                    total = np.concatenate([s.sum(axis=1) for s in scores])
                    if len(total) >= k:
                        floor = max(floor, np.partition(total, len(total) - k)[len(total) - k] - near)
                vector[column[own]] = 0
                cosines = np.concatenate(scores)
                total = cosines.sum(axis=1)
                final = np.flatnonzero((total >= floor) & (total > 0))
                if len(final):
                    new_ = [(-rounded(float(total[j]) / n_parts, digits), block.ids[those[j]], block.keys[those[j]], cosines[j].tolist()) for j in final]
                    best[begin + i] = sorted([*best[begin + i], *new_], key=lambda x: x[:2])[:k]


def found(k: int, n_parts: int, digits: int) -> Callable:
    """For mapInArrow: (country, chunk, theirs, grams, known, block) to FOUND_SCHEMA, chunk by chunk."""

    def known_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        gram, idf = (values.field(f).to_numpy(zero_copy_only=False) for f in ("gram", "idf"))
        order = np.argsort(gram)
        return gram[order], idf[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, texts, best, country = None, None, [], None
        blocks: dict[tuple, Block] = {}

        def out() -> pa.RecordBatch:
            rows = [(country, key, b[2], -b[0], b[3]) for key, own in zip(texts.keys, best, strict=True) for b in own]
            types = [pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.list_(pa.float64())]
            names = ["country", "text_", "cand_text_", "score", "cosines"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                if (key := batch.column("chunk")[i].as_py()) != at:
                    if at is not None:
                        yield out()
                    at, country = key, batch.column("country")[i].as_py()
                    texts = Texts(batch.column("theirs")[i].as_py(), batch.column("grams")[i].values.field("gram").to_numpy(), *known_of(batch.column("known")[i].values), n_parts)
                    best = [[] for _ in texts.keys]
                members = batch.column("block")[i].values
                number = tuple(members.field("chunk").to_pylist())
                if (block := blocks.get(number)) is None:
                    fields = {f: members.field(f) for f in ("ours", "grams", "known")}
                    block = Block([
                        Texts(fields["ours"][j].as_py(), fields["grams"][j].values.field("gram").to_numpy(), *known_of(fields["known"][j].values), n_parts) for j in range(len(members))
                    ])
                    if sum(x.bytes for x in blocks.values()) + block.bytes <= KEPT_BYTES:
                        blocks[number] = block
                improve(best, texts, block, k, n_parts, digits)
        if at is not None:
            yield out()

    return run
