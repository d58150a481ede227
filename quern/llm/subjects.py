"""Subject areas of documents by weak supervision.

Statements (sentences) are taken from a text without speaker labels, the user's
turns, headings, field names, list marks and reference lists.  Four labelling
functions vote on the subject of every statement, one of the subjects or none:

* lexicon - the class a word model gives the statement, with three levels of
  certainty; no vote without a known word;
* section - the class that leads the other statements of its section (of the
  document, where a section has one statement only);
* address and source - the subject that leads the documents of the folder, and of
  the source, if it leads at least ``LEAD`` of them and twice its overall share.

How far each vote can be trusted is learned without labels: a latent-class model
over the vote patterns, fitted by expectation-maximisation from the lexicon's
votes, gives the probability of each class for each pattern.  Patterns are few and
bounded, so they are the only thing collected.  A document's probability of a
subject is that of at least a fifth of its statements having it, from the
statements' probabilities; it has the subjects of probability ``YES`` and more.

The word model is a mixture over statements with a class per subject and one for
none.  It is fitted on at most ``LABELLED`` labelled documents, where a statement
may belong to the document's labels or to none (labels may be wrong), and its
word counts are then taken again over all statements of all documents.  English
and Spanish count by word, Chinese by pairs of characters.  Words are numbered by
a hash below ``BUCKETS``, which bounds the model whatever the vocabulary; each text
is read and parsed once, what follows works on the numbers.

Defined results: null and blank texts and texts without statements have no
subjects; a null source or path casts no vote; a repeated label counts once; a
document with no labelled vocabulary has none.
"""

from __future__ import annotations

import json
import re
import zlib
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import materialise, spread

LABELLED, ROUNDS, YES = 6_000, 12, 0.5
#: A document has a subject if one statement in so many belongs to it.
PART = 5
#: Word numbers; a word model has at most so many rows.
BUCKETS = 1 << 18
#: Probability from which a statement's class is counted in the second fit.
SURE = 0.9
#: Certainty levels of the lexicon's votes.
LEVELS = (0.9, 0.999, 1 - 1e-6)
#: Share of the documents of a folder or source that its subject leads, and the least number of documents.
LEAD, LEAD_COUNT = 1 / 3, 5
#: Times its own votes that a function's stated accuracy counts.
TRUST = 1
VOTES = ("lexicon", "section", "address", "source")

_MARK = re.compile(r"^\s*(?:[-*•>]\s+|\d+[.)]\s+)+")
_SPEAKER = re.compile(r"^\s*(user|human|assistant|system|agent|customer|ai|q|a)\s*[:：]\s*", re.I)
_REFERENCE = re.compile(r"^\s*(references?|sources?( consulted)?|bibliography|further reading|citations?|referencias|fuentes|参考文献|来源)\s*[:：]", re.I)
_STOP = re.compile(r"(?<=[。！？])|(?<=[.!?])[\"'”’)\]]*\s+(?=[\"'“‘(¿¡]?[^\W\d_a-z])|(?<=[.!?])[\"'”’)\]]*\s+(?=\d{3,})")
_SHORT = re.compile(r"\b(?:mr|mrs|ms|dr|prof|st|no|approx|vs|sr|sra|etc|fig)\.$", re.I)
_FIELD = re.compile(r'^\s*\{\s*"[^"]*"\s*:')
_WORD = re.compile(r"[^\W\d_]{2,}")
_HAN = re.compile(r"[㐀-鿿]+")


def sections(text: str) -> list[list[str]]:
    """The statements of a text, by section."""
    out: list[list[str]] = [[]]
    user = False
    for line in text.splitlines():
        if not line.strip():
            continue
        if line.lstrip().startswith("#"):
            out.append([])
            continue
        if _REFERENCE.match(line):
            continue
        speaker = _SPEAKER.match(line)
        if speaker:
            user = speaker[1].lower() in ("user", "human", "customer", "q")
            line = line[speaker.end() :]
        if user:
            continue
        if "<|#|>" in line:
            fields = line.split("<|#|>")
            line = fields[-1] if len(fields) >= 4 else ""
        elif line.strip().startswith("<|"):
            continue
        elif _FIELD.match(line):
            try:
                line = " ".join(str(v) for v in json.loads(line).values())
            except (ValueError, AttributeError):
                line = line.split(":", 1)[1].strip(' "}')
        line = _MARK.sub("", line)
        held = ""
        for part in _STOP.split(line):
            part = (held + " " + part).strip() if held else part.strip()
            if _SHORT.search(part):
                held = part
                continue
            held = ""
            if re.search(r"\w", part):
                out[-1].append(part)
        if held:
            out[-1].append(held)
    return [s for s in out if s]


def features(statement: str) -> list[str]:
    """Words of two letters or more, and character pairs of Chinese runs."""
    low = statement.lower()
    if not _HAN.search(low):
        return _WORD.findall(low)
    words = _WORD.findall(_HAN.sub(" ", low))
    return words + [run[i : i + 2] for run in _HAN.findall(low) for i in range(len(run) - 1)]


def numbers(words: list[str], known: dict[str, int]) -> list[int]:
    """Bucket numbers of words; ``known`` remembers those met before."""
    out = list(map(known.get, words))
    if None in out:
        for i, n in enumerate(out):
            if n is None:
                known[words[i]] = out[i] = zlib.crc32(words[i].encode("utf-8", "surrogatepass")) % BUCKETS
    return out


def _parse(batches):
    """Each text once: word numbers, and word end and section of every statement, as packed integers."""
    known: dict[str, int] = {}
    for batch in batches:
        rows: list[tuple] = []
        for i, t in enumerate(batch.column("text").to_pylist()):
            words: list[int] = []
            ends, parts = [], []
            for k, part in enumerate(sections(t)):
                for statement in part:
                    words += numbers(features(statement), known)
                    ends.append(len(words))
                    parts.append(k)
            if ends:
                rows.append((i, *(np.array(x, np.int32).tobytes() for x in (words, ends, parts))))
        if len(known) > 500_000:
            known.clear()
        at, *packed = zip(*rows) if rows else ((), (), (), ())
        kept = batch.select(["doc_id", "folder", "source"]).take(pa.array(at, pa.int32()))
        yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(x, pa.binary()) for x in packed)], names=["doc_id", "folder", "source", "words", "ends", "parts"])


def _unpack(words: list[bytes], ends: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all statements, the words of each, and the statements of each document."""
    flat = np.frombuffer(b"".join(words), np.int32)
    sizes = np.array([len(e) // 4 for e in ends], np.int64)
    stops = np.frombuffer(b"".join(ends), np.int32).astype(np.int64)
    counts = np.diff(stops, prepend=0)
    starts = np.cumsum(sizes) - sizes
    counts[starts[sizes > 0]] = stops[starts[sizes > 0]]
    return flat, counts, sizes


#: A word model as plain arrays: row of each bucket or -1, log probabilities (row, class), log priors; the last class is none.
Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def word_model(buckets: np.ndarray, counts: np.ndarray, prior: np.ndarray) -> Model:
    a = 0.1
    p = (counts + a) / (counts.sum(axis=0, keepdims=True) + a * max(len(buckets), 1))
    index = np.full(BUCKETS, -1, np.int32)
    index[buckets] = np.arange(len(buckets), dtype=np.int32)
    return index, np.log(p).astype(np.float32), np.log(prior / prior.sum())


def posterior(model: Model, flat: np.ndarray, counts: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Class probabilities of each statement, and whether it has a known word."""
    index, log, prior = model
    rows = index[flat]
    owner = np.repeat(np.arange(len(counts)), counts)[rows >= 0]
    rows = rows[rows >= 0]
    score = np.stack([np.bincount(owner, weights=log[:, c][rows], minlength=len(counts)) for c in range(log.shape[1])], axis=1) + prior
    if allowed is not None:
        score = np.where(allowed, score, -np.inf)
    score -= score.max(axis=1, keepdims=True)
    p = np.exp(score)
    p /= p.sum(axis=1, keepdims=True)
    seen = np.zeros(len(counts), bool)
    seen[owner] = True
    p[~seen] = 0
    p[~seen, -1] = 1
    return p, seen


def fit_labelled(words: list[bytes], ends: list[bytes], labels: list[set[int]], classes: int, rounds: int = ROUNDS) -> Model:
    """The word model from labelled documents; class ``classes`` is none."""
    flat, counts, sizes = _unpack(words, ends)
    may = np.zeros((len(sizes), classes + 1), bool)
    for row, given in zip(may, labels):
        row[[*given, classes]] = True
    may = np.repeat(may, sizes, axis=0)
    buckets, place = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(counts)), counts)
    start = may.astype(float)
    start[:, -1] = 0.5
    p = start / start.sum(axis=1, keepdims=True)
    model = word_model(buckets, np.zeros((len(buckets), classes + 1)), np.ones(classes + 1))
    for _ in range(rounds if len(flat) else 0):
        count = np.stack([np.bincount(place, weights=p[owner, c], minlength=len(buckets)) for c in range(classes + 1)], axis=1)
        model = word_model(buckets, count, p.sum(axis=0) + 1)
        p, _seen = posterior(model, flat, counts, may)
    return model


def _recount(shared, classes: int):
    """Word counts of the sure statements by class, one row a bucket and task."""
    width = classes + 1

    def run(batches):
        codes, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            flat, counts, _ = _unpack(batch.column("words").to_pylist(), batch.column("ends").to_pylist())
            p, _seen = posterior(shared.value, flat, counts)
            cls = np.repeat(np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), -1), counts)
            new, n = np.unique(flat[cls >= 0].astype(np.int64) * width + cls[cls >= 0], return_counts=True)
            codes, place = np.unique(np.r_[codes, new], return_inverse=True)
            sums = np.bincount(place, weights=np.r_[sums, n], minlength=len(codes)).astype(np.int64)
        buckets, place = np.unique(codes // width, return_inverse=True)
        table = np.zeros((len(buckets), width), np.int64)
        table[place, codes % width] = sums
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), *(pa.array(table[:, c]) for c in range(width))], names=["bucket", *(f"n{c}" for c in range(width))])

    return run


def fit_corpus(parsed: DataFrame, first: Model, classes: int) -> Model:
    """The word model with its counts taken over all documents."""
    names = [f"n{c}" for c in range(classes + 1)]
    counted = parsed.select("words", "ends").mapInArrow(_recount(parsed.sparkSession.sparkContext.broadcast(first), classes), "bucket long, " + ", ".join(f"{n} long" for n in names))
    kept = counted.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # at most BUCKETS rows
    counts = np.stack([kept.column(n).to_numpy() for n in names], axis=1).astype(float)
    return word_model(kept.column("bucket").to_numpy(), counts, counts.sum(axis=0) + 1)


def _lead(n: np.ndarray) -> np.ndarray:
    """The leading class of each row of counts, -1 where all are 0."""
    return np.where(n.max(axis=1) > 0, n.argmax(axis=1), -1)


def _vote(shared, classes: int):
    """Lexicon and section votes of every statement as bytes, and the subject that leads the document."""
    width = classes + 1

    def counted(group: np.ndarray, cls: np.ndarray) -> np.ndarray:
        return np.bincount(group * width + cls, minlength=(int(group.max()) + 1) * width).reshape(-1, width)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, counts, sizes = _unpack(batch.column("words").to_pylist(), batch.column("ends").to_pylist())
            parts = np.frombuffer(b"".join(batch.column("parts").to_pylist()), np.int32)
            p, seen = posterior(shared.value, flat, counts)
            cls = p.argmax(axis=1)
            lexicon = np.where(seen, cls * (len(LEVELS) + 1) + np.searchsorted(LEVELS, p.max(axis=1), side="right"), width * (len(LEVELS) + 1))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            group = np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (parts[1:] != parts[:-1])])
            own = np.eye(width, dtype=np.int64)[cls]
            whole = counted(doc, cls)
            beside = _lead(counted(group, cls)[group] - own)
            section = np.where(beside >= 0, beside, _lead(whole[doc] - own))
            section[section < 0] = width
            lead = _lead(whole[:, :classes])
            ends = np.cumsum(sizes)
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends - sizes, ends)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "folder", "source")), cut(lexicon.astype(np.uint8)), cut(section.astype(np.uint8)), pa.array(lead, pa.int32()).filter(pa.array(lead > -2))],
                names=["doc_id", "folder", "source", "lexicon", "section", "lead"])

    return run


def _relations(votes: np.ndarray, answers: int, usual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How the votes of one group stand to each answer: a code, and the log probability of the differing values.

    Each vote abstains, agrees or differs; functions that differ from the answer in
    the same way count as one, since they share the cause.
    """
    y = np.arange(answers)[None, :]
    code, others, value = np.zeros((len(votes), answers), np.int64), np.zeros((len(votes), answers), np.int64), np.zeros((len(votes), answers))
    for j, v in enumerate(votes.T):
        v = v[:, None]
        differs = (v < answers) & (v != y)
        code = code * 3 + np.where(v >= answers, 0, np.where(v == y, 1, 2))
        fresh = differs & ~np.any([votes[:, [i]] == v for i in range(j)] or [np.zeros_like(differs)], axis=0)
        others += fresh
        value += np.where(fresh, np.log(np.maximum(usual, 1e-9))[np.minimum(v, answers - 1)] - np.log(np.maximum(1 - usual, 1e-9))[None, :], 0)
    return code * (votes.shape[1] + 1) + others, value


def latent_posterior(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, fixed: np.ndarray, rounds: int = 50,
                     groups: list[list[int]] | None = None, kinds: np.ndarray | None = None, trust: dict[int, float] | None = None) -> np.ndarray:
    """Probability of the latent answer for each pattern of categorical votes.

    ``patterns`` has a row per pattern and a column per labelling function, with the
    number of an answer, or a larger one for no vote.  ``groups`` lists the columns
    that depend on each other given the answer; their agreement with the answer is
    learned jointly, and groups are independent.  How often the functions agree with
    the answer is learned by EM from ``start``, one rate for each of the ``kinds`` of
    answers (all alike by default).  ``trust`` gives the accuracy that a function
    alone in its group has by itself; it counts as ``TRUST`` times the function's
    votes, without which the answer drifts to what leads a document.  ``start`` has a column per answer, or is the
    probability of yes alone, and so is the result.  Patterns marked ``fixed`` keep
    their start.
    """
    begin = start if start.ndim == 2 else np.stack([1 - start, start], axis=1)
    p, answers = begin.astype(float), begin.shape[1]
    kinds = np.zeros(answers, np.int64) if kinds is None else kinds
    known = []
    for group in groups if groups is not None else [[f] for f in range(patterns.shape[1])]:
        votes = patterns[:, group]
        usual = sum(np.bincount(v[v < answers], weights=counts[v < answers], minlength=answers) for v in votes.T) + 1e-6
        code, value = _relations(votes, answers, usual / usual.sum())
        # Codes of a lone vote: 0 none, 2 agrees, 5 differs.
        own = np.flatnonzero(votes[:, 0] < answers) if trust and len(group) == 1 and group[0] in trust else None
        known.append((code, value, max(int(code.max()) + 1, 6), own, trust[group[0]] if own is not None else 0.0))
    for _ in range(rounds):
        weight = p * counts[:, None]
        score = np.log(np.clip(weight.sum(axis=0) / counts.sum(), 1e-6, 1 - 1e-6))[None, :].repeat(len(p), axis=0)
        for code, value, width, own, sure in known:
            rate = np.bincount((code + width * kinds[None, :]).ravel(), weights=weight.ravel(), minlength=width * (int(kinds.max()) + 1)).reshape(-1, width) + 0.5
            if own is not None:
                voted = rate[:, 2] + rate[:, 5]
                right = (rate[:, 2] + TRUST * voted * sure) / (1 + TRUST) / voted
                rate[:, 2], rate[:, 5] = voted * right, voted * (1 - right)
            rate /= rate.sum(axis=1, keepdims=True)
            score += np.log(rate)[kinds[None, :], code] + value
        score -= score.max(axis=1, keepdims=True)
        fresh = np.exp(score)
        fresh /= fresh.sum(axis=1, keepdims=True)
        p = np.where(fixed[:, None], begin, fresh)
    return p if start.ndim == 2 else p[:, 1]


def _patterns(batch: pa.RecordBatch, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The vote pattern of every statement as one number, and the statements of each document."""
    votes = [batch.column(c).to_pylist() for c in ("lexicon", "section")]
    sizes = np.array([len(x) for x in votes[0]], np.int64)
    lexicon, section = (np.frombuffer(b"".join(x), np.uint8).astype(np.int64) for x in votes)
    code = lexicon * (classes + 2) + section
    for c in ("address", "origin"):
        code = code * (classes + 1) + np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes)
    return code, sizes


def _count_patterns(classes: int):
    def run(batches):
        for batch in batches:
            codes, n = np.unique(_patterns(batch, classes)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    return run


def _decide(shared, classes: int):
    """Probability of every subject from the statements' probabilities: that at least one in ``PART`` has it."""
    def run(batches):
        codes, p = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            code, sizes = _patterns(batch, classes)
            each = p[np.searchsorted(codes, code)]
            starts = np.cumsum(sizes) - sizes
            mean, spread_ = np.add.reduceat(each, starts, axis=0), np.add.reduceat(each * (1 - each), starts, axis=0)
            # The number of such statements is a sum of independent draws; its distribution is taken as normal.
            need = -(-sizes // PART) - 0.5
            doc, subject = np.nonzero(mean[:, :classes] >= 0.05)
            z = (mean[doc, subject] - need[doc]) / np.sqrt(spread_[doc, subject] + 1e-6)
            normal = NormalDist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(subject, pa.int32()), pa.array(mean[doc, subject] / sizes[doc]), pa.array([normal.cdf(x) for x in z], pa.float64())],
                names=["doc_id", "subject_no", "share", "probability"])

    return run


def _leaders(voted: DataFrame, column: str, alias: str, base: dict[int, float]) -> DataFrame:
    """``column, alias``: the subject that leads the documents of a folder or source, where one does."""
    seen = voted.filter(F.col(column).isNotNull() & (F.col("lead") >= 0)).groupBy(column, "lead").agg(F.count(F.lit(1)).alias("n"))
    top = seen.groupBy(column).agg(F.max_by("lead", F.struct("n", "lead")).alias(alias), F.max("n").alias("n"), F.sum("n").alias("all"))
    usual = F.element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), F.col(alias)) if base else F.lit(1.0)
    return top.filter((F.col("all") >= LEAD_COUNT) & (F.col("n") >= F.col("all") * LEAD) & (F.col("n") >= F.col("all") * usual * 2)).select(column, alias)


def subject_votes(documents: DataFrame, labels: DataFrame, names: list[str], labelled: int = LABELLED, use: tuple[str, ...] = VOTES) -> DataFrame:
    """``doc_id, subject, share, probability`` for every subject some statement may belong to.

    ``use`` names the labelling functions whose votes the latent model sees.
    """
    spark, classes = documents.sparkSession, len(names)
    number = {s: i for i, s in enumerate(names)}
    folder = F.nullif(F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1), F.lit(""))
    texts = spread(documents.select("doc_id", "text", folder.alias("folder"), "source").filter("doc_id is not null and text <> ''"))
    parsed = materialise(texts.mapInArrow(_parse, "doc_id long, folder string, source string, words binary, ends binary, parts binary"), "subjects-parsed")
    # The sample is taken by a hash of the id among the documents that have labels.
    given = (labels.select("doc_id", "subject").filter(F.col("subject").isin(names)).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    sample = parsed.select("doc_id", "words", "ends").join(F.broadcast(given), "doc_id").collect()  # at most ``labelled`` rows on either side
    sample.sort(key=lambda r: r["doc_id"])
    first = fit_labelled([r["words"] for r in sample], [r["ends"] for r in sample], [{number[s] for s in r["subjects"]} for r in sample], classes)
    model = fit_corpus(parsed, first, classes)
    voted = materialise(parsed.mapInArrow(_vote(spark.sparkContext.broadcast(model), classes), "doc_id long, folder string, source string, lexicon binary, section binary, lead int"), "subjects-voted")
    leads = {r["lead"]: r["n"] for r in voted.filter("lead >= 0").groupBy("lead").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a subject
    base = {k: n / sum(leads.values()) for k, n in leads.items()}
    # Documents without a folder or source are spread over keys that no table holds.
    none = F.concat(F.lit("\0"), F.pmod(F.xxhash64("doc_id"), F.lit(4096)))
    told = voted.withColumns({c: F.coalesce(c, none) for c in ("folder", "source")})
    told = told.join(_leaders(voted, "folder", "address", base), "folder", "left").join(_leaders(voted, "source", "origin", base), "source", "left")
    told = materialise(told.select("doc_id", "lexicon", "section", *[F.coalesce(c, F.lit(classes)).alias(c) for c in ("address", "origin")]), "subjects-told")
    seen = told.mapInArrow(_count_patterns(classes), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()  # bounded by the vote values
    code, radix = seen.column("code").to_numpy(), [classes + 2, classes + 1, classes + 1]
    patterns, rest = [], code
    for r in reversed(radix):
        patterns.append(rest % r)
        rest = rest // r
    patterns = np.stack([rest, *reversed(patterns)], axis=1)
    p = _learned(patterns, seen.column("n").to_numpy().astype(float), classes, use)
    subject = F.element_at(F.array(*[F.lit(s) for s in names]), F.col("subject_no") + 1) if names else F.lit(None).cast("string")
    decided = told.mapInArrow(_decide(spark.sparkContext.broadcast((code, p)), classes), "doc_id long, subject_no int, share double, probability double")
    return decided.select("doc_id", subject.alias("subject"), "share", "probability")


def _learned(patterns: np.ndarray, counts: np.ndarray, classes: int, use: tuple[str, ...]) -> np.ndarray:
    """Class probabilities of each pattern of the votes ``VOTES``.

    The lexicon's votes of each level of certainty are a function of their own, and
    the start.  Section, address and source all follow what the whole document is
    about, so they are one group.
    """
    levels, none = len(LEVELS) + 1, classes + 1
    lexicon, section, address, source = patterns.T
    cast = lexicon < levels * (classes + 1)
    split = [np.where(cast & (lexicon % levels == k), lexicon // levels, none) for k in range(levels)]
    # Address and source have no vote for the class none: its number means that they do not vote.
    columns = np.stack([*split, section, *(np.where(x == classes, none, x) for x in (address, source))], axis=1)
    start = np.full((len(patterns), classes + 1), 1 / (classes + 1))
    certain = np.array([0.7, *LEVELS])
    sure = certain[lexicon % levels]
    start[cast] = ((1 - sure) / max(classes, 1))[cast, None]
    start[np.flatnonzero(cast), lexicon[cast] // levels] = sure[cast]
    groups = [[k] for k in range(levels)] if "lexicon" in use else []
    context = [levels + i for i, v in enumerate(VOTES[1:]) if v in use]
    if not len(patterns):
        return start
    return latent_posterior(columns, counts, start, np.zeros(len(patterns), bool), groups=groups + [context] * bool(context), kinds=(np.arange(classes + 1) == classes).astype(np.int64),
                            trust=dict(enumerate(certain.tolist())))


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, use: tuple[str, ...] = VOTES) -> DataFrame:
    """``doc_id, subject, share, probability``: the subjects of each document, by the latent model's probability."""
    names = [r["subject"] for r in subjects.select("subject").filter("subject is not null").distinct().orderBy("subject").collect()]  # a fixed small table
    return subject_votes(documents, labels, names, use=use).filter(F.col("probability") >= YES)
