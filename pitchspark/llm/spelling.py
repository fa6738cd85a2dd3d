"""Spelling variants of words, found by an index of variable-length grams.

Two words are near if one inserted, deleted or replaced code point turns one into the other. The
frequent grams of all words, of ``QMIN`` letters and more, are extended by a letter until they are
rare or as long as may be: this pruned tree is the dictionary. A word is decomposed into the longest
dictionary gram at each of its places. An edit leaves a gram before it in its place from the start,
unless the gram reaches the edit or the dictionary could extend it across, and a gram behind it in
its place from the end. So from the word and the dictionary alone follows how many of its grams one
edit can affect at most, wherever it falls.

Two near words therefore share all but that many grams, for the bounds of both words. Of a word's
inverted lists, keyed by gram and place from the start or from the end, as many of the most frequent
ones as the bound allows are skipped: by the order of frequencies, the first gram that two near
words share is among the rarest (bound + 1) of both. Words of one list are compared in the list's
task by their letters, then verified, and only near words leave it. Lists with very many words are
cut into blocks, and each two blocks compared in a task of their own.

What a dictionary lacks costs time, never a pair: that one is bounded loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import removed, stored

QMIN = 2
# Grams of at most this many code points; a word of n has n - QMIN + 1 grams, and one edit affects
# at most QMAX of them.
QMAX = 5
# A gram of more words than this is extended, unless that makes more than MAX_GRAMS dictionary grams
# (some 20 MB in each Python worker).
PRUNE = 256
MAX_GRAMS = 200_000
# A list with more words is cut into blocks of half as many.
RUN = 4096
_ROWS = 200_000


def gram_counts(words: DataFrame, qmin: int, qmax: int) -> DataFrame:
    """gram and n, the places in different words that it has."""
    size = F.length("word")
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(qmin), F.lit(qmax)),
            lambda q: F.when(
                size >= q,
                F.transform(F.sequence(F.lit(1), size - q + 1), lambda p: F.substring("word", p, q)),
            ).otherwise(F.array().cast("array<string>")),
        )
    )
    return words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def gram_dictionary(words: DataFrame, qmin: int, qmax: int, prune: int, max_grams: int) -> dict[str, tuple]:
    """For each gram of the dictionary its frequency and whether it is extended.

    At most ``max_grams`` besides those of ``qmin`` code points leave Spark: the limit above which
    grams are extended rises until that holds.
    """
    counts = stored(gram_counts(words, qmin, qmax), "spelling-grams")
    longer = counts.where(F.length("gram") > qmin)
    stems = counts.where((F.length("gram") < qmax) & (F.col("n") > prune))
    stems = stems.select(F.col("gram").alias("stem"), F.col("n").alias("stem_n"))
    stem = F.expr("substring(gram, 1, length(gram) - 1)")
    entries = stored(longer.withColumn("stem", stem).join(stems, "stem"), "spelling-dictionary")
    beyond = entries.orderBy(F.desc("stem_n")).select("stem_n").offset(max_grams).limit(1).collect()
    limit = max(prune, beyond[0][0]) if beyond else prune
    short = counts.where(F.length("gram") == qmin).select("gram", "n")
    # Short grams are bounded likewise: those left out count as rare ones.
    short = short.orderBy(F.desc("n"), "gram").limit(max_grams)
    rows = short.unionAll(entries.where(F.col("stem_n") > limit).select("gram", "n")).collect()
    removed(words.sparkSession, counts)
    removed(words.sparkSession, entries)
    return {r["gram"]: (r["n"], r["n"] > limit and len(r["gram"]) < qmax) for r in rows}


def decomposed(word: str, dictionary: dict[str, tuple], qmin: int, qmax: int) -> list[str]:
    """The longest dictionary gram at each place; where there is none, that of ``qmin`` letters."""
    size, grams = len(word), []
    for p in range(size - qmin + 1):
        end = p + qmin
        known = dictionary.get(word[p:end])
        while known and known[1] and end < size:
            known = dictionary.get(word[p : end + 1])
            if known is None:
                # An extended gram that no other word has; the tree stays as deep for it.
                known = (0, False)
            end += 1
        grams.append(word[p:end])
    return grams


def affected(word: str, grams: list[str], dictionary: dict[str, tuple], qmin: int, qmax: int) -> int:
    """How many of the word's grams one edit can affect at most."""
    size, most = len(word), 0
    for i in range(size + 1):  # an edit of the letter at i, or an insertion before it
        count = 1 if i < len(grams) else 0
        for p in range(max(0, i - qmax + 1), min(i, len(grams))):
            if p + len(grams[p]) > i or i - p < qmin:
                count += 1
            else:
                known = dictionary.get(word[p:i])
                # The gram ends before the edit; it stays unless a letter at i could extend it.
                count += bool(known and known[1])
        most = max(most, count)
    return most


def kept_lists(word: str, dictionary: dict[str, tuple], qmin: int, qmax: int) -> list[tuple[int, str]]:
    """Places and grams of the lists that two near words meet in: the rarest, one more than an edit
    can affect, and any tied with the last.

    Of a gram that the word has very often, the first and the last qmax + 1 places are enough: if an
    edit spares the first as it is, at most qmax new ones come before it, if it spares the last as
    seen from the end, none comes behind it, and if it spares neither, there are few.
    """
    grams = decomposed(word, dictionary, qmin, qmax)
    bound = affected(word, grams, dictionary, qmin, qmax)
    ranks = [(dictionary.get(g, (0, False))[0], g) for g in grams]
    last = sorted(ranks)[min(bound, len(grams) - 1)]
    found: dict[str, list[int]] = {}
    for p, (gram, rank) in enumerate(zip(grams, ranks, strict=True)):
        if rank <= last:
            found.setdefault(gram, []).append(p)
    ends = qmax + 1
    return [
        (p, gram)
        for gram, places in found.items()
        for p in (places if len(places) <= 2 * ends else places[:ends] + places[-ends:])
    ]


def postings(words: DataFrame, dictionary: dict[str, tuple], qmin: int, qmax: int) -> DataFrame:
    """key (of gram, side and place), size, word and n: the word's places in inverted lists."""
    shared = words.sparkSession.sparkContext.broadcast(dictionary)
    schema = "key long, size int, word string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        known = shared.value
        for batch in batches:
            keys, places = [], []
            words = batch.column("word").to_pylist()
            for i, word in enumerate(words):
                size = len(word)
                for p, gram in kept_lists(word, known, qmin, qmax):
                    # Lists that share a hash by chance are one longer list.
                    keys.append(xxh3_64_intdigest(f"<{p} {gram}"))
                    keys.append(xxh3_64_intdigest(f">{size - p} {gram}"))
                    places += (i, i)
            sizes = np.fromiter(map(len, words), np.int32, len(words))
            at = np.array(places, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(keys, dtype=np.uint64).view(np.int64)),
                    pa.array(sizes[at]),
                    batch.column("word").take(pa.array(at)),
                    batch.column("n").take(pa.array(at)),
                ],
                names=["key", "size", "word", "n"],
            )

    return words.select("word", "n").mapInArrow(run, schema)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes one word the other."""
    short, long = sorted((a, b), key=len)
    if a == b or len(long) - len(short) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[at + (len(short) == len(long)) :] == long[at + 1 :]


class Letters:
    """Words as rows of code points, aligned at the start and at the end, with sets of letters.
    Words of more than WIDTH code points are compared one by one."""

    WIDTH = 48

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.words, self.sizes, width = words, sizes, self.WIDTH
        inside = np.arange(width) < sizes[:, None]
        codes = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
        self.front = np.where(inside, codes + 1, 0)
        at = np.arange(width) - (width - np.minimum(sizes, width))[:, None]
        self.back = np.where(at >= 0, np.take_along_axis(self.front, np.maximum(at, 0), 1), 0)
        bits = np.uint64(1) << (self.front & np.uint32(63)).astype(np.uint64)
        self.sets = np.bitwise_or.reduce(np.where(inside, bits, np.uint64(0)), axis=1)
        for i in np.flatnonzero(sizes > width).tolist():
            self.sets[i] = sum(1 << (c & 63) for c in {ord(x) + 1 & 63 for x in words[i]})

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs of places that are one edit apart; sizes differ by one at most."""
        use = np.bitwise_count(self.sets[a] ^ self.sets[b]) <= 2
        a, b = a[use], b[use]
        if not len(a):
            return a, b
        # Letters alike from the start and from the end, up to the first that differ.
        front = self.front[a] != self.front[b]
        back = self.back[a, ::-1] != self.back[b, ::-1]
        alike = front.argmax(axis=1) + back.argmax(axis=1)
        use = front.any(axis=1) & (alike >= np.maximum(self.sizes[a], self.sizes[b]) - 1)
        for i in np.flatnonzero(np.maximum(self.sizes[a], self.sizes[b]) > self.WIDTH).tolist():
            use[i] = one_edit(self.words[a[i]], self.words[b[i]])
        return a[use], b[use]


LINK = "a string, a_n long, b string, b_n long"


def _links(words: np.ndarray, counts: np.ndarray, left: list, right: list) -> pd.DataFrame:
    a = np.concatenate(left) if left else np.zeros(0, np.int64)
    b = np.concatenate(right) if right else np.zeros(0, np.int64)
    swap = words[a] > words[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return pd.DataFrame({"a": words[a], "a_n": counts[a], "b": words[b], "b_n": counts[b]})


def _near_in_runs(keys, sizes, words, counts) -> pd.DataFrame:
    """Near words within runs of equal keys, in rows sorted by key and size."""
    letters, left, right = Letters(words, sizes), [], []
    at, d = np.arange(len(keys)), 0
    while True:
        d += 1
        at = at[at + d < len(keys)]
        at = at[(keys[at] == keys[at + d]) & (sizes[at + d] - sizes[at] <= 1)]
        if not len(at):
            return _links(words, counts, left, right)
        a, b = letters.near(at, at + d)
        if len(a):
            left.append(a)
            right.append(b)


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        columns = [frame[c].to_numpy() for c in ("key", "size", "word", "n")]
        return _near_in_runs(*columns).drop_duplicates(ignore_index=True)

    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) < _ROWS:
            continue
        frame = pd.concat(held, ignore_index=True)
        keys = frame["key"].to_numpy()
        end = int(np.argmax(keys == keys[-1]))
        held = [frame.iloc[end:]]
        if end:
            yield of(frame.iloc[:end])
    if held:
        yield of(pd.concat(held, ignore_index=True))


def _blocks(_key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.drop_duplicates("word").sort_values(["size", "word"], ignore_index=True)
    frame["key"] = 0
    return _near_in_runs(*[frame[c].to_numpy() for c in ("key", "size", "word", "n")])


def near_words(
    words: DataFrame,
    qmin: int = QMIN,
    qmax: int = QMAX,
    prune: int = PRUNE,
    max_grams: int = MAX_GRAMS,
    run: int = RUN,
) -> DataFrame:
    """a, a_n, b and b_n: each pair of near words once, a before b, with their n.

    ``words`` has word (each once, stored) and n; each word needs qmin + qmax code points at least,
    for of fewer grams one edit could affect all.
    """
    dictionary = gram_dictionary(words, qmin, qmax, prune, max_grams)
    lists = stored(postings(words, dictionary, qmin, qmax), "spelling-lists")
    large = stored(lists.groupBy("key").count().where(F.col("count") > run), "spelling-large")
    usual = lists
    if any_large := not large.isEmpty():
        usual = lists.join(large, "key", "left_anti")
    links = usual.repartition("key").sortWithinPartitions("key", "size").mapInPandas(_runs, LINK)
    if any_large:
        blocks = F.ceil(F.col("count") * 2 / run).cast("long")
        mine, other = F.pmod(F.xxhash64("word"), F.col("blocks")), F.col("other")
        links = links.unionAll(
            lists.join(large.withColumn("blocks", blocks), "key")
            .select(
                "key", "size", "word", "n", mine.alias("mine"),
                F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
            )
            .groupBy("key", F.least("mine", other).alias("x"), F.greatest("mine", other).alias("y"))
            .applyInPandas(_blocks, LINK)
        )
    return links.distinct()


def variant_groups(words: DataFrame, factor: int = 10, **options) -> DataFrame:
    """word, form, root, n, n_near and form_n for the different words of ``words`` (word, n).

    Rows that repeat a word are added up; null words are left out, a null n counts as 0. A word's
    form is its near word of the largest n (ties: the smallest by code points), if that is at least
    ``factor`` times the word's own, else null; form_n is the form's n. Following forms leads to
    the root, the word itself if it has no form: n grows with every step, so that ends. n_near is
    the number of near words, 0 if there is none. Other columns are not read; no row gives no row.
    ``options`` are those of ``near_words``, which asks for a least length of words.
    """
    if factor < 2:
        raise ValueError("factor must be 2 at least, so that forms lead to an end")
    spark = words.sparkSession
    least = options.get("qmin", QMIN) + options.get("qmax", QMAX)
    words = stored(
        words.where(words["word"].isNotNull())
        .groupBy(words["word"].alias("word"))
        .agg(F.coalesce(F.sum(words["n"]), F.lit(0)).cast("long").alias("n")),
        "spelling-words",
    )
    if not words.where(F.length("word") < least).isEmpty():
        raise ValueError(f"words need {least} code points at least, by qmin and qmax")
    pairs = stored(near_words(words, **options), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), "a_n", F.col("b").alias("other"), "b_n").unionAll(
        pairs.select(F.col("b").alias("word"), F.col("b_n").alias("a_n"), F.col("a").alias("other"), F.col("a_n").alias("b_n"))
    )
    best = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("other").alias("word")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    forms = F.when((-F.col("best.less") >= factor * F.col("n")) & (F.col("best.less") < 0), F.col("best.word"))
    found = stored(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            forms.alias("form"),
            F.when(forms.isNotNull(), -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    # Each round doubles the steps that a pointer covers; there are as many as n has digits, or so.
    steps = stored(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if steps.join(ahead, "root", "left_semi").isEmpty():
            break
        after = stored(
            steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")),
            "spelling-roots",
        )
        removed(spark, steps)
        steps = after
    return found.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def runs_of_letters(docs: DataFrame) -> Column:
    """The maximal runs of A-Z, a-z and U+00C0 to U+00FF of the text, with A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.coalesce(docs["text"], F.lit("")), upper, upper.lower())
    return F.regexp_extract_all(text, F.lit("[a-zÀ-ÿ]+"), F.lit(0))
