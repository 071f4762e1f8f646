"""Language fingerprints: the most frequent padded character n-grams, and rank distances."""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

PROFILE, LONGEST, TOGETHER = 400, 5, 48


def grams(docs: DataFrame, keys: list[str], text: str = "text", longest: int = LONGEST) -> DataFrame:
    """keys, gram, n: counts of the n-grams of words between underscores, the underscore alone left out.

    Words are counted before they are cut up, so frequent words are cut once for a key.
    """
    words = docs.select(*keys, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), 0)).alias("w"))
    words = words.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("c"))
    padded = F.concat(F.lit("_"), F.col("w"), F.lit("_"))
    cuts = []
    for n in range(1, longest + 1):
        starts = F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.length(padded) - (n - 1))).otherwise(F.array().cast("array<int>"))
        cuts.append(F.transform(starts, _cut(padded, n)))
    rows = words.select(*keys, "c", F.explode(F.concat(*cuts)).alias("gram")).where("gram <> '_'")
    return rows.groupBy(*keys, "gram").agg(F.sum("c").alias("n"))


def _cut(word, n: int):
    return lambda i: F.substring(word, i, F.lit(n))


def ranked(counts: DataFrame, keys: list[str], size: int = PROFILE) -> DataFrame:
    """keys, gram, rank of the most frequent grams, ties by gram."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select(*keys, "gram", "rank")


def profiles(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, gram, rank of each language; grams are counted where the texts lie."""
    kind = docs.schema[lang].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16 * TOGETHER):
                part = batch.slice(at, 16 * TOGETHER)
                keys, lines = part.column(0).to_pylist(), part.column(1).to_pylist()
                langs = list(dict.fromkeys(keys))
                words: list[Counter] = [Counter() for _ in langs]
                place = {x: k for k, x in enumerate(langs)}
                for key, line in zip(keys, lines):
                    if line:
                        words[place[key]].update(line.split(" "))
                owner, gram, n, names = _counted(words)
                yield pa.RecordBatch.from_arrays([pa.array([langs[k] for k in owner.tolist()], part.column(0).type), names(gram), pa.array(n)], names=["lang", "gram", "n"])

    found = docs.select(F.col(lang).alias("lang"), _line(text)).mapInArrow(run, f"lang {kind}, gram string, n long")
    return ranked(found.groupBy("lang", "gram").agg(F.sum("n").alias("n")), ["lang"]).select(F.col("lang").alias(lang), "gram", "rank")


def _line(text: str) -> Column:
    """The words of a text between blanks."""
    return F.array_join(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), 0), " ").alias("words")


def distances(docs: DataFrame, models: DataFrame, doc_id: str = "doc_id", text: str = "text", max_models: int = 1000) -> DataFrame:
    """doc_id, lang, distance: summed rank differences, a gram missing from the model counting PROFILE.

    A document's own profile is a function of its text, so it is made in place and nothing is
    shuffled. Models have PROFILE rows a language; with up to ``max_models`` languages they go
    to the tasks, with more the profiles are joined.
    """
    rows = models.select("lang", "gram", "rank").limit(max_models * PROFILE + 1).collect()
    if len(rows) > max_models * PROFILE:
        return _joined(docs, models, doc_id, text)
    langs = sorted({r["lang"] for r in rows})
    model: dict[str, list[tuple[int, int]]] = {}
    for r in rows:
        model.setdefault(r["gram"], []).append((langs.index(r["lang"]), r["rank"]))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(langs, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                doc, lang, apart = _ranked_together(part.column(1).to_pylist(), model, len(langs))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), names.take(pa.array(lang)), pa.array(apart)], names=[doc_id, "lang", "distance"])

    return docs.select(F.col(doc_id).alias("d"), _line(text)).mapInArrow(run, f"{doc_id} {kind}, lang string, distance long")


def _counted(words: list[Counter]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """(owner, gram, count) of the grams of each owner's words, and the strings of gram numbers.

    Grams are numbered in the order of their strings. Each distinct word is cut up once, for all
    owners and as one array of characters.
    """
    number: dict[str, int] = defaultdict(itertools.count().__next__)
    word = np.array(list(map(number.__getitem__, itertools.chain.from_iterable(words))), np.int64)
    times = np.array(list(itertools.chain.from_iterable(c.values() for c in words)), np.int64)
    owner = np.repeat(np.arange(len(words)), [len(c) for c in words])
    if not len(word):
        z = np.zeros(0, np.int64)
        return z, z, z, lambda k: pa.array([], pa.string())
    # the words with an underscore on either side; a character's rank has b bits, 0 for none
    body = "_" + "__".join(number) + "_"
    signs, text = np.unique(np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    b = max(1, int(len(signs)).bit_length())
    if b * LONGEST > 62:
        return _counted_strings(words)
    size = np.fromiter(map(len, number), np.int64) + 2
    end = np.repeat(np.cumsum(size), size)
    underscore = int(text[0])
    left, first = end - np.arange(len(text)), np.arange(len(text))
    text = np.concatenate([text.astype(np.int64) + 1, np.zeros(LONGEST, np.int64)])
    codes, of, local = [], [], []
    held, many = np.repeat(np.arange(len(size)), size), np.zeros(len(size), np.int64)
    code = np.zeros(len(left), np.int64)
    for n in range(1, LONGEST + 1):
        code = code | (text[first + n - 1] << (b * (LONGEST - n)))
        fits = left >= n if n > 1 else text[first] != underscore + 1
        codes.append(code[fits])
        of.append(held[fits])
        each = np.bincount(of[-1], minlength=len(size))
        local.append(np.arange(len(of[-1])) + (many - np.cumsum(each) + each)[of[-1]])
        many = many + each
    start = np.cumsum(many) - many
    grams, codes = _numbered(np.concatenate(codes), b * LONGEST)
    pieces = np.empty(len(codes), np.int64)
    pieces[np.concatenate(local) + start[np.concatenate(of)]] = codes
    # an owner's pieces, counted in a dense table of a few owners at a time
    found = []
    step = max(1, (1 << 20) // len(grams))
    borders = np.searchsorted(owner, np.arange(0, len(words) + step, step))
    for k, (a, z) in enumerate(zip(borders[:-1], borders[1:])):
        if a == z:
            continue
        w, n = word[a:z], many[word[a:z]]
        at = np.repeat(start[w] - np.cumsum(n) + n, n) + np.arange(n.sum())
        table = np.bincount(np.repeat((owner[a:z] - k * step) * len(grams), n) + pieces[at], np.repeat(times[a:z], n))
        key = np.flatnonzero(table)
        found.append((key // len(grams) + k * step, key % len(grams), table[key].astype(np.int64)))

    def names(k: np.ndarray) -> pa.Array:
        c = grams[k]
        chars = np.stack([(c >> (b * (LONGEST - 1 - j))) & ((1 << b) - 1) for j in range(LONGEST)], axis=1)
        return pa.array(["".join(map(chr, r)).rstrip("\0") for r in np.concatenate([[0], signs])[chars].tolist()], pa.string())

    return *(np.concatenate(x) for x in zip(*found)), names


def _numbered(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in their order, and the number of each code; by one sort of plain numbers where place and code fit one."""
    low = len(codes).bit_length()
    if bits + low > 62:
        return np.unique(codes, return_inverse=True)
    key = (codes << low) | np.arange(len(codes))
    key.sort()
    code = key >> low
    new = np.concatenate([[True], code[1:] != code[:-1]])
    back = np.empty(len(codes), np.int64)
    back[key & ((1 << low) - 1)] = np.cumsum(new) - 1
    return code[new], back


def _counted_strings(words: list[Counter]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """:func:`_counted` by strings, for alphabets of thousands of signs."""
    counts: list[Counter] = []
    for c in words:
        counts.append(Counter())
        for w, n in c.items():
            for g in _grams_of(w):
                counts[-1][g] += n
    grams = sorted(set().union(*counts))
    place = {g: k for k, g in enumerate(grams)}
    rows = np.array([(d, place[g], n) for d, c in enumerate(counts) for g, n in c.items()], np.int64).reshape(-1, 3)
    return rows[:, 0], rows[:, 1], rows[:, 2], lambda k: pa.array([grams[x] for x in k.tolist()], pa.string())


def _ranked_together(lines: list[str | None], model: dict[str, list[tuple[int, int]]], n_langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, language, distance) of texts as words between blanks."""
    doc, gram, count, names = _counted([Counter(line.split(" ") if line else ()) for line in lines])
    if not len(doc):
        z = np.zeros(0, np.int64)
        return z, z, z
    order = _order(doc, gram, count)
    doc, gram = doc[order], gram[order]
    start = np.searchsorted(doc, np.arange(len(lines)))
    rank = np.arange(len(doc)) - start[doc] + 1
    top = rank <= PROFILE
    doc, gram, rank = doc[top], gram[top], rank[top]
    used, gram = np.unique(gram, return_inverse=True)
    known = np.zeros((n_langs, len(used)), np.int64)
    for k, g in enumerate(names(used).to_pylist()):
        for lang, r in model.get(g, ()):
            known[lang, k] = r
    total, apart, hits = np.bincount(doc, minlength=len(lines)), np.zeros((len(lines), n_langs), np.int64), np.zeros((len(lines), n_langs), np.int64)
    for lang in range(n_langs):
        r = known[lang][gram]
        hits[:, lang] = np.bincount(doc[r > 0], minlength=len(lines))
        apart[:, lang] = np.bincount(doc[r > 0], np.abs(rank - r)[r > 0], len(lines))
    i, lang = np.nonzero(hits)
    return i, lang, (apart + PROFILE * (total[:, None] - hits))[i, lang]


def _order(doc: np.ndarray, gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The order by text, falling count and gram; as one sorted number where it fits one."""
    most, n = int(count.max()), len(doc)
    bits = [int(x).bit_length() for x in (doc.max(), most, n)]
    if sum(bits) > 62:
        return np.lexsort((gram, -count, doc))
    # places rise with the text and the gram within it, as the table was read in that order
    if np.any(np.diff(doc * (int(gram.max()) + 1) + gram) <= 0):
        return np.lexsort((gram, -count, doc))
    key = (doc << (bits[1] + bits[2])) | ((most - count) << bits[2]) | np.arange(n)
    key.sort()
    return key & ((1 << bits[2]) - 1)


def _grams_of(word: str) -> list[str]:
    p = f"_{word}_"
    return [p[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(p) - n + 1) if n > 1 or p[i] != "_"]


def _joined(docs: DataFrame, models: DataFrame, doc_id: str, text: str) -> DataFrame:
    d = ranked(grams(docs, [doc_id], text), [doc_id])
    size = d.groupBy(doc_id).agg(F.count(F.lit(1)).alias("m"))
    m = models.select("lang", "gram", F.col("rank").alias("r2"))
    hits = d.join(m, "gram").groupBy(doc_id, "lang").agg(F.sum(F.abs(F.col("rank") - F.col("r2"))).alias("s"), F.count(F.lit(1)).alias("k"))
    return hits.join(size, doc_id).select(doc_id, "lang", (F.col("s") + PROFILE * (F.col("m") - F.col("k"))).alias("distance"))


def classify(dist: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, distance: the nearest model, ties by name."""
    best = dist.groupBy(doc_id).agg(F.min(F.struct("distance", "lang")).alias("b"))
    return best.select(doc_id, F.col("b.lang").alias("lang_pred"), F.col("b.distance").alias("distance"))


def candidates(dist: DataFrame, doc_id: str = "doc_id", slack: float = 1.03) -> DataFrame:
    """doc_id, labels: ``[lang]`` of all models within the slack of the nearest, the nearest first."""
    best = F.min("distance").over(Window.partitionBy(doc_id))
    near = dist.withColumn("best", best).where(F.col("distance") <= slack * F.col("best"))
    return near.groupBy(doc_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("distance", "lang"))), lambda s: F.concat(F.lit("["), s["lang"], F.lit("]"))), "").alias("labels"))
