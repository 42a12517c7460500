"""Problem 10: the subjects each document is about.

Method: normalised document vectors are clustered by bisecting k-means. A leaf whose hand-labelled documents disagree is
divided by them, and every leaf is named by its discriminative terms. A term belongs to the leaves it occurs in, a sentence
to the mixture of the leaves of its terms, and a document takes the subjects of the leaves that lead in its sentences.
Words are 64-bit hashes from the first step on, so all passes over the corpus work on arrays.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.session import materialize, table

#: Rows of a vocabulary or label table that are sent to the tasks as a whole (some tens of megabytes); a larger one is joined.
MOST_SENT = 300_000
#: Longest signature, in lines that are not blank; a rule with more below it divides the text.
SIGNATURE_LINES = 8

_QUOTE = re.compile(r"\[(?P<bopen>quote)(?:=[^\]\n]*)?\]|\[/(?P<bclose>quote|qoute|qute|qoute|quotes)\]|<(?P<hopen>blockquote)\b[^>\n]*>|</(?P<hclose>blockquote)\s*>", re.IGNORECASE)
_MARKUP = re.compile(r"\[(?:img|url)(?:=[^\]\n]*)?\]\s*(?:https?://\S*?)?(?=\[/|\s|$)|\[/?[a-z*]+(?:=[^\]\n]*)?\]|</?[a-z][^>\n]*>", re.IGNORECASE)
_QUOTED_LINE = re.compile(r"^\s*[>|]")
_SIGN_LINE = re.compile(r"^\s*(?:--+|_{4,}|\[hr\].*|<hr\s*/?>.*|~{1,2}[^~\n]{1,40}~{1,2})\s*$", re.IGNORECASE)
_ATTRIBUTION = re.compile(r"(?:wrote|said|schrieb|escribió|dijo|sagte)\b[^.?!\n]{0,60}:\s*$", re.IGNORECASE)
_ADDRESS = re.compile(r"://|\bwww\.|\S@\S|\b[\w-]+\.(?:example|com|net|org|info|biz|ru|de|es)\b|★|>>>|<<<|!!!", re.IGNORECASE)
_SENTENCE = re.compile(r"(?<=[.?!…])[)\"'»]*\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_UNSEEN = dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD))
_MOJIBAKE = re.compile(r"[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{1,3}")


def _mended(m: re.Match) -> str:
    """UTF-8 that was read as a Western code page, read again; anything else stays."""
    for page in ("cp1252", "latin-1"):
        try:
            return m[0].encode(page).decode()
        except UnicodeError:
            continue
    return m[0]


def own_lines(text: str) -> list[str]:
    """Lines outside quotations. Tags nest, an outer tag closes the open ones inside it, and a tag may close in a marked
    line; tags that a marked line opens end with the marked lines; one that never closes reaches to the next blank line."""
    kept: list[str] = []
    inside: list[str] = []  # lines since the outermost open tag
    open_tags: list[str] = []
    marked_tags: list[str] = []
    for line in text.split("\n"):
        marked = bool(_QUOTED_LINE.match(line))
        if not marked:
            marked_tags = []
        own, at = [], 0
        for m in _QUOTE.finditer(line):
            if not open_tags and not marked:
                own.append(line[at : m.start()])
            kind = "b" if m["bopen"] or m["bclose"] else "h"
            if m["bopen"] or m["hopen"]:
                if not marked and not open_tags:
                    inside = []
                (marked_tags if marked else open_tags).append(kind)
            else:
                for tags in (marked_tags, open_tags):
                    if kind in tags:
                        while tags.pop() != kind:
                            pass
                        break
            at = m.end()
        if not open_tags and not marked:
            own.append(line[at:])
        if own:
            kept.append(" ".join(own))
        elif open_tags and not marked:
            inside.append(line)
    if open_tags and "" in (blank := [x.strip() for x in inside]):
        kept += inside[blank.index("") + 1 :]
    return kept


def _without_signature(lines: list[str]) -> list[str]:
    """Lines before the first rule that has a short tail; other rules only divide the text."""
    filled = np.cumsum([bool(x.strip()) for x in lines])
    for k, line in enumerate(lines):
        if _SIGN_LINE.match(line) and filled[-1] - filled[k] <= SIGNATURE_LINES:
            return lines[:k]
    return lines


def own_sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence that the author wrote: without quotations in brackets, tags or line marks, attributions,
    signatures, markup and advertising."""
    if not text or not text.strip():
        return []
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", _MOJIBAKE.sub(_mended, text.translate(_UNSEEN).replace("\u00a0", " ")))
    kept = [ln for ln in _without_signature(own_lines(text)) if not (ln.rstrip().endswith(":") and _ATTRIBUTION.search(ln))]
    text = _MARKUP.sub(" ", "\n".join(kept))
    advertised = _ADDRESS.search(text)
    sentences = (s for s in _SENTENCE.split(text) if s and not (advertised and _ADDRESS.search(s)))
    return [w for s in sentences if (w := _WORD.findall(s.lower()))]


@functools.lru_cache(maxsize=1 << 18)
def term_of(word: str) -> int:
    """A word as a signed 64-bit hash."""
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(values, kind))


def sentences(documents: DataFrame) -> DataFrame:
    """Table ``(doc_id, words, ends)``: the terms of a document's own sentences, and where each sentence ends among them;
    documents without any have empty lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, ends, n_words, n_ends = [], [], [], []
            for text in b.column("text").to_pylist():
                said, at = own_sentences(text), 0
                for sentence in said:
                    words += map(term_of, sentence)
                    at += len(sentence)
                    ends.append(at)
                n_words.append(at)
                n_ends.append(len(said))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "words": _lists(np.array(words, np.int64), np.array(n_words, np.int64), pa.int64()), "ends": _lists(np.array(ends, np.int32), np.array(n_ends, np.int64), pa.int32())})

    rows = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, "doc_id long, words array<long>, ends array<int>").dropDuplicates(["doc_id"]), "said")


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(values, row of each)`` of a list column."""
    n = np.asarray(col.value_lengths().fill_null(0))
    return np.asarray(col.flatten()), np.repeat(np.arange(len(n)), n)


def _small(df: DataFrame) -> DataFrame:
    """The table with a broadcast hint if it is small enough to be sent."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def _counts(rows: DataFrame, group: str) -> DataFrame:
    """``(term, group, n)`` over rows of ``(words, group)``: the rows of each group that have the term.

    Every batch adds up its own terms first, so the shuffle has each term about once per batch and group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, row = _flat(b.column("words"))
            terms, code = np.unique(words, return_inverse=True)
            groups = b.column(group).dictionary_encode()
            once = np.unique(np.stack([row, code]), axis=1) if len(words) else np.zeros((2, 0), np.int64)
            own = groups.indices.to_numpy(zero_copy_only=False)[once[0]].astype(np.int64)
            pair, n = np.unique(once[1] * max(1, len(groups.dictionary)) + own, return_counts=True)
            t, g = np.divmod(pair, max(1, len(groups.dictionary)))
            yield pa.record_batch({"term": pa.array(terms[t], pa.int64()), group: groups.dictionary.take(pa.array(g)), "n": pa.array(n.astype(np.int64))})

    kind = rows.schema[group].dataType.simpleString()
    return rows.filter(F.col(group).isNotNull()).select("words", group).mapInArrow(run, f"term long, {group} {kind}, n long").groupBy("term", group).agg(F.sum("n").alias("n"))


def indifferent_terms(named: DataFrame, least_docs: int = 12, most_gain: float = 0.35) -> DataFrame:
    """``(term,)``: words that hand-labelled documents of all subjects use alike, such as function words.

    ``named`` is ``(term, subject, n)`` over labelled documents. The gain is the divergence in nats of the subjects of a
    term's documents from those of all of them.
    """
    prior = named.groupBy("subject").agg(F.sum("n").alias("m"))
    total = prior.agg(F.sum("m")).first()[0] or 1
    p = F.col("n") / F.col("all")
    gain = named.withColumn("all", F.sum("n").over(Window.partitionBy("term"))).join(prior, "subject").withColumn("g", p * F.log(p * F.lit(total) / F.col("m")))
    return gain.groupBy("term").agg(F.sum("g").alias("gain"), F.max("all").alias("docs")).filter((F.col("docs") >= least_docs) & (F.col("gain") < most_gain)).select("term")


def _content_words(said: DataFrame, plain: DataFrame) -> DataFrame:
    """``(doc_id, words)``: distinct words of each document that are not ``plain``, of documents with at least two.

    The plain words go to the tasks as a set if they are at most :data:`MOST_SENT`, else by a join on every word.
    """
    rows = said.select("doc_id", F.array_distinct("words").alias("words"))
    if plain.count() > MOST_SENT:
        rows = rows.select("doc_id", F.explode("words").alias("term")).join(plain, "term", "left_anti").groupBy("doc_id").agg(F.collect_list("term").alias("words"))
    else:
        skip = [r["term"] for r in plain.collect()]
        rows = rows.select("doc_id", F.array_except("words", F.array(*[F.lit(t) for t in skip]).cast("array<long>")).alias("words")) if len(skip) <= 2_000 else rows.join(F.broadcast(plain.agg(F.collect_list("term").alias("skip")))).select("doc_id", F.array_except("words", "skip").alias("words"))
    return rows.filter(F.size("words") >= 2)


def leaves(said: DataFrame, plain: DataFrame, k: int, dims: int = 1 << 12, rounds: int = 8, seed: int = 11) -> DataFrame:
    """Table ``(doc_id, words, leaf)`` by bisecting k-means over all documents' normalised tf-idf vectors of hashed words,
    without ``plain`` ones; ``words`` are the distinct ones. Documents of fewer than two words have no leaf."""
    words = materialize(_content_words(said, plain), "words")
    if words.isEmpty():
        return words.select("doc_id", "words", F.lit(0).alias("leaf"))
    named = words.withColumn("names", F.transform("words", lambda w: w.cast("string")))
    tf = HashingTF(inputCol="names", outputCol="tf", numFeatures=dims, binary=True).transform(named)
    idf = IDF(inputCol="tf", outputCol="weighted", minDocFreq=3).fit(tf)
    vectors = materialize(Normalizer(inputCol="weighted", outputCol="features").transform(idf.transform(tf)).select("doc_id", "words", "features"), "doc-vectors")
    model = BisectingKMeans(k=k, maxIter=rounds, seed=seed, featuresCol="features", predictionCol="leaf", minDivisibleClusterSize=8.0).fit(vectors)
    return materialize(model.transform(vectors).select("doc_id", "words", "leaf"), "leaves")


def divided(leaf: DataFrame, sure: DataFrame) -> DataFrame:
    """``leaf`` with leaves that hand labels show to be mixed divided by the subjects of their labelled documents.

    A labelled document goes to the part of its subject, the others of its leaf to the part whose labelled documents use
    its words most (cosine of tf-idf), ties to the first by name. Leaves become texts, parts have their subject behind.
    """
    told = materialize(leaf.join(_small(sure), "doc_id"), "told")
    mixed = materialize(told.groupBy("leaf").agg(F.count_distinct("subject").alias("k")).filter("k > 1").select("leaf"), "mixed")
    whole = leaf.join(_small(mixed), "leaf", "left_anti").withColumn("leaf", F.col("leaf").cast("string"))
    inside = materialize(leaf.join(_small(mixed), "leaf", "left_semi"), "inside")
    total = max(1, leaf.count())
    idf = _counts(leaf.withColumn("all", F.lit(1)), "all").select("term", F.log(F.lit(float(total)) / (1 + F.col("n"))).alias("idf")).filter("idf > 0")
    part = F.concat_ws("\x1f", F.col("leaf").cast("string"), "subject")
    profile = _counts(told.join(_small(mixed), "leaf", "left_semi").withColumn("part", part), "part").join(idf, "term").withColumn("w", F.col("n") * F.col("idf"))
    size = profile.groupBy("part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    at = lambda k: F.element_at(F.split("part", "\x1f"), k)
    profile = materialize(profile.join(size, "part").select("term", at(1).cast("int").alias("leaf"), at(2).alias("subject"), (F.col("w") / F.col("size") * F.col("idf")).alias("w")), "profile")
    said = inside.select("doc_id", "leaf", F.explode("words").alias("term")).join(_small(profile), ["leaf", "term"])
    best = said.groupBy("doc_id", "subject").agg(F.round(F.sum("w"), 9).alias("score")).groupBy("doc_id").agg(F.min_by("subject", F.struct(-F.col("score"), "subject")).alias("near"))
    placed = inside.join(told.select("doc_id", "subject"), "doc_id", "left").join(best, "doc_id", "left").withColumn("own", F.coalesce("subject", "near"))
    return materialize(whole.select("doc_id", "words", "leaf").unionByName(placed.select("doc_id", "words", F.concat_ws(":", F.col("leaf").cast("string"), "own").alias("leaf"))), "parts")


def _majority(labels: DataFrame) -> DataFrame:
    """``(doc_id, subject)``: the subjects that most annotators of a document name (all of a tie)."""
    votes = labels.filter(F.col("doc_id").isNotNull() & F.col("subject").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "subject", "annotator").distinct().groupBy("doc_id", "subject").agg(F.count("*").alias("n"))
    return votes.withColumn("best", F.max("n").over(Window.partitionBy("doc_id"))).filter("n = best").select("doc_id", "subject")


def leaf_subjects(in_leaf: DataFrame, leaf: DataFrame, named: DataFrame, labelled: DataFrame, terms: int = 40, least_share: float = 0.3) -> DataFrame:
    """``(leaf, subject)``: each leaf named after its discriminative terms.

    ``in_leaf`` and ``named`` are ``(term, leaf, n)`` and ``(term, subject, n)`` over documents. A leaf's terms are those
    most over-represented in it; the subject is the one whose hand-labelled documents use these terms most in excess of
    their share of all labelled words. ``labelled`` is ``(doc_id)``; a leaf of small talk has next to none of these and is
    not named: it needs ``least_share`` of what its size lets expect.
    """
    by_term = Window.partitionBy("term")
    by_leaf = leaf.groupBy("leaf").agg(F.count("*").alias("leaf_docs"))
    all_docs = leaf.count()
    excess = in_leaf.withColumn("term_docs", F.sum("n").over(by_term)).join(by_leaf, "leaf")
    excess = excess.filter(F.col("term_docs") >= 5).withColumn("gain", F.col("n") * F.log((F.col("n") * F.lit(all_docs)) / (F.col("term_docs") * F.col("leaf_docs"))))
    top = excess.withColumn("rank", F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("gain"), "term"))).filter((F.col("rank") <= terms) & (F.col("gain") > 0)).select("leaf", "term", "gain")
    share = named.withColumn("all", F.sum("n").over(by_term)).withColumn("of_subject", F.sum("n").over(Window.partitionBy("subject")))
    total = named.agg(F.sum("n")).first()[0] or 1
    # excess over what the subject's share of all labelled words lets expect
    lift = share.select("term", "subject", (F.col("n") / F.col("all") - F.col("of_subject") / F.lit(total)).alias("lift"))
    rate = F.lit(least_share * labelled.count() / max(1, all_docs))
    spoken = leaf.join(_small(labelled), "doc_id", "left_semi").groupBy("leaf").agg(F.count("*").alias("n")).join(by_leaf, "leaf").filter(F.col("n") >= rate * F.col("leaf_docs")).select("leaf")
    score = top.join(spoken, "leaf", "left_semi").join(lift, "term").groupBy("leaf", "subject").agg(F.sum(F.col("gain") * F.col("lift")).alias("score")).filter("score > 0")
    return score.withColumn("rank", F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("score"), "subject"))).filter("rank = 1").select("leaf", "subject")


def _weights(counts: DataFrame, least: float, floor: int) -> DataFrame:
    """``(term, subject, p)`` of the terms of which at least ``least`` belongs to a subject, from ``(term, subject, n)``."""
    by_subject = counts.groupBy("subject").agg(F.sum("n").alias("of_subject"))
    p = counts.withColumn("all", F.sum("n").over(Window.partitionBy("term"))).filter(F.col("all") >= floor).join(by_subject, "subject")
    total = counts.agg(F.sum("n")).first()[0] or 1
    share = F.col("n") / (F.col("all") + 1)
    return p.withColumn("p", share).filter((F.col("p") >= least) & (F.col("n") / F.col("all") >= 2.5 * F.col("of_subject") / F.lit(total))).select("term", "subject", "p")


def mentions(sentence: np.ndarray, term: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Evidence of ``n`` sentences for each subject, from the sentence of each word and its row in ``weights`` (-1: none):
    neighbouring terms of a subject are one mention and count once, by the strongest, so one mention, however worded,
    counts at most 1."""
    score = np.zeros((n, weights.shape[1]))
    known = np.flatnonzero(term >= 0)
    own = weights[term[known]]
    for s in range(weights.shape[1]):
        hit = own[:, s] > 0
        at = known[hit]
        if len(at):
            first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (sentence[at[1:]] != sentence[at[:-1]])])
            score[:, s] = np.bincount(sentence[at[first]], np.maximum.reduceat(own[hit, s], first), minlength=n)
    return score


def _strongest(score: np.ndarray, evidence: float) -> np.ndarray:
    """The subject of most evidence of each row if that is enough, else -1; ties to the first."""
    best = score.argmax(1) if score.shape[1] else np.zeros(len(score), np.int64)
    return np.where((score.max(1, initial=0) >= evidence), best, -1)


def _mixture(said: DataFrame, weights: DataFrame, evidence: float, count_terms: bool) -> DataFrame:
    """The subjects of all sentences: ``(term, subject, n)`` over the words of the sentences that have one, or
    ``(doc_id, subject)``.

    Term weights go to the tasks if there are at most :data:`MOST_SENT`; beyond, by a join that gives each document the
    weights of its own words.
    """
    names = sorted(r["subject"] for r in weights.select("subject").distinct().collect())

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Sorted terms and their weights for each subject."""
        terms, at = np.unique(t.column("term").to_numpy(), return_inverse=True)
        w = np.zeros((len(terms), len(names)))
        w[at, np.searchsorted(names, t.column("subject").to_pylist())] = t.column("p").to_numpy()
        return terms, w

    if weights.count() <= MOST_SENT:
        sent = said.sparkSession.sparkContext.broadcast(arrays(weights.select("term", "subject", "p").toArrow()))
        rows = said.select("doc_id", "words", "ends")
    else:
        sent = None
        words = said.select("doc_id", F.explode(F.array_distinct("words")).alias("term")).join(weights, "term")
        rows = said.join(words.groupBy("doc_id").agg(F.collect_list(F.struct("term", "subject", "p")).alias("own")), "doc_id").select("doc_id", "words", "ends", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, w = sent.value if sent is not None else arrays(pa.Table.from_struct_array(b.column("own").flatten()))
            words, doc = _flat(b.column("words"))
            ends, of = _flat(b.column("ends"))
            before = np.append(0, np.cumsum(np.bincount(doc, minlength=b.num_rows)))
            sentence = np.searchsorted(before[of] + ends, np.arange(len(words)), "right")
            row = np.minimum(np.searchsorted(terms, words), max(0, len(terms) - 1))
            row = np.where(terms[row] == words, row, -1) if len(terms) else np.full(len(words), -1)
            score = mentions(sentence, row, w, len(ends))
            about = _strongest(score, evidence)
            if count_terms:
                at = np.flatnonzero(about[sentence] >= 0) if len(words) else np.zeros(0, np.int64)
                own, code = np.unique(words[at], return_inverse=True)
                pair, n = np.unique(code * len(names) + about[sentence[at]], return_counts=True) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                t, g = np.divmod(pair, max(1, len(names)))
                yield pa.record_batch({"term": pa.array(own[t], pa.int64()), "subject": pa.array([names[x] for x in g], pa.string()), "n": pa.array(n.astype(np.float64))})
            else:
                pair = np.unique(np.stack([of[about >= 0], about[about >= 0]]), axis=1)
                whole = np.zeros((b.num_rows, len(names)))
                np.add.at(whole, of, score)
                whole[pair[0]] = 0
                alone = _strongest(whole, evidence)
                d, g = np.r_[pair[0], np.flatnonzero(alone >= 0)], np.r_[pair[1], alone[alone >= 0]]
                yield pa.record_batch({"doc_id": b.column("doc_id").take(pa.array(d, pa.int64())), "subject": pa.array([names[x] for x in g], pa.string())})

    out = rows.mapInArrow(run, "term long, subject string, n double" if count_terms else "doc_id long, subject string")
    return out.groupBy("term", "subject").agg(F.sum("n").alias("n")) if count_terms else out


def _added(counts: DataFrame, told: DataFrame, trust: float) -> DataFrame:
    """Counts of the leaves with those of the labelled documents, which together weigh ``trust`` times as much."""
    sums = [df.agg(F.sum("n")).first()[0] or 0 for df in (counts, told)]
    more = told.withColumn("n", F.col("n") * float(trust * sums[0] / max(1, sums[1])))
    return counts.withColumn("n", F.col("n").cast("double")).unionByName(more).groupBy("term", "subject").agg(F.sum("n").alias("n"))


def subjects_of(documents: DataFrame, labels: DataFrame, k: int = 96, evidence: float = 1.3, least: float = 0.25, refine: int = 1, trust: float = 0.3) -> DataFrame:
    """``(doc_id, subject)``: every subject that at least one own sentence of the document is about, or where no
    sentence has enough evidence by itself, the one that all of them together are about.

    A term's weight for a subject is the share of the leaves of that name in the documents it occurs in, of which the
    documents with one hand label are ``trust`` times as much again. ``refine`` times, the leaves' counts give way to those
    of the sentences whose mixture has enough evidence, over all documents. Without a named leaf there are no subjects.
    Null, blank and removed texts give no rows, null keys are left out, and of repeated keys one row counts.
    """
    said = sentences(documents)
    named = materialize(_counts(said.join(_small(_majority(labels)), "doc_id"), "subject"), "named")
    sure = labels.filter(F.col("doc_id").isNotNull() & F.col("subject").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("subject").alias("subject"), F.count_distinct("subject").alias("k")).filter("k = 1").drop("k")
    sure = materialize(sure, "sure")

    plain = materialize(indifferent_terms(named), "plain")
    leaf = divided(leaves(said, plain, k), sure)
    told = materialize(_counts(leaf.join(_small(sure), "doc_id"), "subject"), "told")
    in_leaf = materialize(_counts(leaf, "leaf"), "in-leaf")
    name = leaf_subjects(in_leaf, leaf, named, sure.select("doc_id"))
    counts = materialize(in_leaf.join(F.broadcast(name), "leaf").groupBy("term", "subject").agg(F.sum("n").alias("n")), "of-leaves")
    weights = materialize(_weights(_added(counts, told, trust), least, 5), "weights")
    for _ in range(refine):
        counts = materialize(_mixture(said, weights, evidence, True), "of-sentences")
        weights = materialize(_weights(_added(counts, told, trust), least, 3), "weights")
    return _mixture(said, weights, evidence, False)


def p10_found(spark, sf_dir: str) -> DataFrame:
    return subjects_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_subject_labels"))


def p10_composition(spark, sf_dir: str) -> DataFrame:
    """Documents by language tag and subject."""
    docs = table(spark, sf_dir, "documents")
    return p10_found(spark, sf_dir).join(docs.select("doc_id", F.lower(F.substring("lang", 1, 2)).alias("lang")), "doc_id").groupBy("lang", "subject").agg(F.count("*").alias("n_docs"))
