"""Subject areas of documents by class-association rules over sentences.

Sentences of labelled documents are transactions of words with the document's
subject as one more item.  Parallel frequent-pattern growth mines rules from
sets of words to subjects; a rule that adds nothing to a more general one is
pruned.  A sentence that recurs word for word under many subjects is a rule of
its own, to no subject.  The evidence of the matching rules becomes a probability
by a calibration on labelled documents that no rule was mined from.  A
document's share of a subject is the mean of these probabilities over its
sentences with a subject, and the subject comes out if the share reaches a limit.

The rules are fitted on a bounded sample of labelled documents and are looked
up in memory; scoring reads every document once and shuffles nothing.
"""

from __future__ import annotations

import html
import itertools
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class SubjectParams:
    """labelled: most labelled documents the rules are mined from, taken by a hash of their id."""

    labelled: int = 20_000
    share: float = 0.25
    min_documents: int = 3
    min_support: int = 3
    min_confidence: float = 0.15
    word_share: float = 0.35
    #: Most words of a rule that is looked up; the pruning has left none of more than two so far.
    longest: int = 4
    #: One in so many labelled documents is kept for the calibration.
    held: int = 7
    smoothing: float = 2.0
    #: Least evidence of one rule for a sentence to have a subject, as a part of the most its subject can have.
    evidence: float = 0.45
    neutral_subjects: int = 3
    neutral_share: float = 0.6
    #: A sentence in so many documents without a subject has none, whatever the others are about.
    neutral_documents: int = 2
    glued: int = 24


_INVISIBLE = regex.compile(r"[\p{Cf}\p{Co}\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_BROKEN = regex.compile(r"[ÃÂâ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
_VALUE = regex.compile(r'"text"\s*:\s*"((?:[^"\\]|\\.)*)"?', regex.IGNORECASE)
_COUNTER = regex.compile(r"\w+=\d+")
_LINK = regex.compile(r"\w+://\S+")
_FENCE = regex.compile(r"```.*?(?:```|\Z)", regex.DOTALL)
_TABLE = regex.compile(r"(?m)^\s*\|.*$")
_LEFT_OUT = (("```", _FENCE, "\n"), ("|", _TABLE, ""), ("://", _LINK, " "), ("=", _COUNTER, " "))
_SPEAKER = regex.compile(r"^\p{Lu}[\p{L}'’-]{1,24}:\s*")
_MARK = regex.compile(r"^\s*(?:(?:[-*•·–—>#]+|\d+[.)])\s*)*(?:\[[^\]\n]{3,24}\]\s*)?")
_END = regex.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|(?<=\p{Ll}[.!?)])(?=[¿¡]?(?:\d+)?\p{Lu})")
_WORD = regex.compile(r"\p{L}+")


def _repaired(text: str) -> str:
    """Undo UTF-8 that was read as Windows-1252, where that gives valid text."""
    if not _BROKEN.search(text):
        return text
    raw = bytearray()
    for c in text:
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 255:
                return text
            raw.append(ord(c))
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return text


def sentences(text: str | None) -> list[list[str]]:
    """The lower-case words of each sentence; request and record lines give the sentences of their text values."""
    if not text:
        return []
    text = _INVISIBLE.sub("", text)
    if "\r" in text or not text.isascii():
        lines = text.splitlines()
        if _BROKEN.search(text):
            lines = [_repaired(line) for line in lines]
        text = unicodedata.normalize("NFC", "\n".join(lines))
    # Each pattern only where its mark is: most texts have none of them.
    for mark, pattern, instead in _LEFT_OUT:
        if mark in text:
            text = pattern.sub(instead, text)
    if '"' in text and _VALUE.search(text):
        lines = []
        for m in _VALUE.finditer(text):
            try:
                lines.append(json.loads(f'"{m[1]}"'))
            except ValueError:
                lines.append(m[1])
    else:
        lines = text.split("\n")
    out = []
    for line in lines:
        if "&" in line:
            line = html.unescape(line)
        if not line[:1].isalpha():
            line = _MARK.sub("", line)
        if ":" in line:
            line = _SPEAKER.sub("", line)
        for s in _END.split(line):
            words = _WORD.findall(s.lower()) if s else []
            if words:
                out.append(words)
    return out


def squashed(words: list[str]) -> str:
    return "".join(words)


@dataclass
class Rules:
    """antecedents: a sorted tuple of words to the logarithm of (confidence / prior) for each subject."""

    subjects: list[str]
    antecedents: dict[tuple[str, ...], np.ndarray]
    neutral: set[str]
    params: SubjectParams
    #: Prior share of each subject.
    prior: np.ndarray
    #: The factor of the evidence at which it predicts the labels of other documents best.
    sharpness: float = 1.0
    words: set[str] = field(default_factory=set)
    _finder: object = None
    _memo: dict = field(default_factory=dict)

    def __post_init__(self):
        self.words = {w for a in self.antecedents for w in a}
        self.reach = min(max(map(len, self.antecedents), default=0), self.params.longest)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_finder", "_memo")} | {"_finder": None, "_memo": {}}

    def cut(self, words: list[str]) -> list[str]:
        """Known words inside runs of letters without spaces, longest first from the left."""
        if max(map(len, words)) <= self.params.glued:
            return words
        long = [w for w in self.words if len(w) > 3]
        if not long:
            return [w for w in words if len(w) <= self.params.glued]
        if self._finder is None:
            import ahocorasick

            self._finder = ahocorasick.Automaton()
            for w in long:
                self._finder.add_word(w, w)
            self._finder.make_automaton()
        out = []
        for w in words:
            if len(w) <= self.params.glued:
                out.append(w)
            else:
                out += [x for _, x in self._finder.iter_long(w)]
        return out

    def evidence(self, words: list[str]) -> np.ndarray | None:
        """Sum over the matching rules of a sentence, null if it has no subject; a rule inside a longer matching one is left out.

        Depends on the known words alone, of which few sets occur: each is worked out once.
        """
        known = tuple(sorted(self.words.intersection(self.cut(words))))
        if not known or squashed(words) in self.neutral:
            return None
        if known not in self._memo:
            if len(self._memo) > 200_000:
                self._memo.clear()
            self._memo[known] = self._sum(known)
        return self._memo[known]

    def _sum(self, known: tuple[str, ...]) -> np.ndarray | None:
        hits = [c for n in range(min(self.reach, len(known)), 0, -1) for c in itertools.combinations(known, n) if c in self.antecedents]
        covered: set[tuple[str, ...]] = set()
        total, best = np.zeros(len(self.subjects)), 0.0
        for h in hits:
            if h in covered:
                continue
            for n in range(1, len(h)):
                covered.update(itertools.combinations(h, n))
            e = self.antecedents[h]
            total += e
            best = max(best, float((e / -np.log(self.prior)).max()))
        return total if best >= self.params.evidence else None

    def document(self, text: str | None) -> tuple[np.ndarray, int]:
        """Mean probability of each subject over the sentences with a subject, and the number of those."""
        found = [e for e in map(self.evidence, sentences(text)) if e is not None]
        if not found:
            return np.zeros(len(self.subjects)), 0
        return probabilities(np.array(found), self.sharpness).mean(axis=0), len(found)


def probabilities(evidence: np.ndarray, sharpness: float) -> np.ndarray:
    """Of each row of evidence the probability of every subject."""
    z = sharpness * (evidence - evidence.max(axis=1, keepdims=True))
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


#: What the calibration chooses from: factors of the evidence, and shares of labels that are wrong.
SHARPNESS = (0.25, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0, 4.0)
WRONG = (0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.25)


def calibrated(rules: Rules, held: DataFrame) -> Rules:
    """The rules with the sharpness under which the labels of held sentences (subject, words) are most likely.

    A label is taken to be wrong with a probability that is chosen along with
    it.  Every partition gives one sum for each choice, so nothing else comes
    to the driver.  Without a held sentence that has evidence, it stays at 1.
    """
    model = held.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = model.value
        place = {s: i for i, s in enumerate(r.subjects)}
        for batch in batches:
            rows = [(r.evidence(w), place[s]) for s, w in zip(batch.column("subject").to_pylist(), batch.column("words").to_pylist()) if s in place]
            rows = [(e, k) for e, k in rows if e is not None]
            if not rows:
                continue
            evidence, label = np.array([e for e, _ in rows]), np.array([k for _, k in rows])
            sums = []
            for t in SHARPNESS:
                p = probabilities(evidence, t)[np.arange(len(label)), label]
                sums += [float(np.log((1 - w) * p + w / len(place)).sum()) for w in WRONG]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums, pa.float64())], ["choice", "likely"])

    found = held.select("subject", "words").mapInArrow(run, "choice int, likely double").groupBy("choice").agg(F.sum("likely").alias("likely"))
    best = found.agg(F.max_by("choice", F.struct("likely", -F.col("choice")))).first()[0]
    rules.sharpness = 1.0 if best is None else SHARPNESS[best // len(WRONG)]
    return rules


def labelled(documents: DataFrame, labels: DataFrame, subjects: DataFrame, p: SubjectParams) -> DataFrame:
    """(doc_id, text, subject) of documents with one subject, "" for none; spelling variants are one, others dropped."""
    known = subjects.select(F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isNotNull()).distinct()
    named = labels.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(F.lower(F.trim("subject")), F.lit("")).alias("subject"))
    kept = named.where(F.col("subject") == "").unionByName(named.join(known, "subject", "left_semi"))
    each = kept.groupBy("doc_id").agg(F.array_remove(F.collect_set("subject"), "").alias("s")).where(F.size("s") < 2)
    single = each.select("doc_id", F.coalesce(F.try_element_at("s", F.lit(1)), F.lit("")).alias("subject"))
    chosen = single.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.labelled)
    return documents.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])


_TRANSACTIONS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("subject", T.StringType()), T.StructField("form", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])


def transactions(rows: DataFrame, p: SubjectParams) -> DataFrame:
    """(doc_id, subject, form, words): one row per sentence, words distinct, sentences without spaces left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, subject, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "subject", "text"))):
                out += [(doc, subject, squashed(w), sorted(set(w))) for w in sentences(text) if max(map(len, w)) <= p.glued]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())))], _TRANSACTIONS.names)

    return rows.select("doc_id", "subject", "text").mapInArrow(run, _TRANSACTIONS)


def mine(documents: DataFrame, labels: DataFrame, subjects: DataFrame, p: SubjectParams = SubjectParams()) -> Rules:
    """Rules from the labelled documents, calibrated; what comes to the driver is bounded by ``p.labelled``."""
    names = sorted(r.s for r in subjects.select(F.lower(F.trim("subject")).alias("s")).where("s IS NOT NULL").distinct().collect())
    every = transactions(labelled(documents, labels, subjects, p), p).withColumn("held", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(p.held)) == 0).persist()
    rows = every.where(~F.col("held"))
    per = rows.groupBy("form", "subject").agg(F.countDistinct("doc_id").alias("n"))
    flat = per.groupBy("form").agg(F.sum("n").alias("n"), F.max(F.when(F.col("subject") != "", F.col("n")).otherwise(0)).alias("most"), F.count(F.lit(1)).alias("k"), F.max(F.when(F.col("subject") == "", F.col("n")).otherwise(0)).alias("none"))
    spread = (F.col("k") >= p.neutral_subjects) & (F.col("most") <= p.neutral_share * F.col("n"))
    flat = flat.where(spread | (F.col("none") >= p.neutral_documents))
    neutral = {r.form for r in flat.select("form").collect()}
    kept = rows.join(F.broadcast(flat.select("form")), "form", "left_anti").where(F.col("subject") != "").persist()
    # Words that lean to a subject; the others are in no rule, and would only multiply the patterns.
    by_word = kept.select("doc_id", "subject", F.explode("words").alias("word")).groupBy("word", "subject").agg(F.countDistinct("doc_id").alias("n"))
    lean = by_word.groupBy("word").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where((F.col("n") >= p.min_documents) & (F.col("most") >= p.word_share * F.col("n")) & (F.char_length("word") > 2))
    prior = {r.subject: r.n for r in kept.groupBy("subject").agg(F.countDistinct("doc_id").alias("n")).collect()}
    total = sum(prior.values())
    if not total:
        return Rules(names, {}, neutral, p, np.full(len(names), 1 / max(len(names), 2)))
    base = kept.withColumn("row", F.xxhash64("doc_id", "form"))
    items = base.select("row", "subject", F.explode("words").alias("word")).join(F.broadcast(lean.select("word")), "word").groupBy("row", "subject").agg(F.collect_set("word").alias("words"))
    baskets = items.select(F.array_append("words", F.concat(F.lit("#"), "subject")).alias("items")).persist()
    count = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=p.min_support / max(count, 1), minConfidence=p.min_confidence).fit(baskets)
    sets = model.freqItemsets.where(F.size(F.filter("items", lambda x: ~x.startswith("#"))) <= p.longest).collect()
    counts = {frozenset(r["items"]): r["freq"] for r in sets}
    found: dict[tuple[str, ...], dict[str, int]] = defaultdict(dict)
    for s, n in counts.items():
        tag = [x for x in s if x.startswith("#")]
        if len(tag) == 1 and len(s) > 1:
            found[tuple(sorted(s - set(tag)))][tag[0][1:]] = n
    share = np.array([(prior.get(s, 0) + 1) / (total + len(names)) for s in names])
    rules: dict[tuple[str, ...], np.ndarray] = {}
    for a in sorted(found, key=len):
        n = counts[frozenset(a)]
        got = np.array([found[a].get(s, 0) for s in names], dtype=float)
        confidence = (got + p.smoothing * share) / (n + p.smoothing)
        if got.max() / n < p.min_confidence:
            continue
        best = int(np.argmax(confidence))
        general = [rules[b] for k in range(1, len(a)) for b in itertools.combinations(a, k) if b in rules]
        value = np.log(np.maximum(confidence, 0.005) / share)
        # A longer rule stays only if it says more for its subject than each more general rule.
        if general and max(g[best] for g in general) >= value[best] - 0.05:
            continue
        rules[a] = value
    out = calibrated(Rules(names, rules, neutral, p, np.minimum(share, 0.99)), every.where(F.col("held") & (F.col("subject") != "")))
    for d in (every, kept, baskets):
        d.unpersist()
    return out


def document_subjects(documents: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, subject, share, sentences): the subjects that at least ``share`` of a document's subject sentences are about.

    Documents whose text is null or empty, or has no sentence with a subject,
    give no row.  Rows are scored one by one: repeated ids give repeated rows.
    """
    model = documents.sparkSession.sparkContext.broadcast(rules)
    schema = T.StructType([documents.schema[id_col], T.StructField("subject", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("sentences", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = model.value
        for batch in batches:
            rows: list[int] = []
            said: list[str] = []
            part: list[float] = []
            many: list[int] = []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                shares, n = r.document(text)
                for k in np.flatnonzero(shares >= r.params.share) if n else ():
                    rows.append(i)
                    said.append(r.subjects[k])
                    part.append(float(shares[k]))
                    many.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(said, pa.string()), pa.array(part, pa.float64()), pa.array(many, pa.int32())], [id_col, "subject", "share", "sentences"])

    return documents.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema)
