"""Variant spellings of names typed by people.

1. Each distinct name becomes a list of plain tokens: accents, case, quotes,
   titles and letters typed as digits are levelled, abbreviations written out.
2. Distinct tokens get keys that make candidate pairs: what is left of the token
   without a letter, in tokens that may hold two errors without two, so that every
   pair within one edit (two in long tokens) shares one, and hardly any other does.
   Tokens of more than ``LONG`` letters have pieces instead, which find all as well.
   Only hashes of keys are moved, packed by bucket, and pairs are made in arrays.
3. Names with two pairs of tokens that can be partners (:func:`_name_keys`) are
   compared by a
   Monge-Elkan similarity over their tokens, where equal words, nicknames,
   initials, abbreviations and single typing errors count, and every full word
   of either name must find its partner.  Years must be equal.
4. The links are clustered by star clustering: the name with most links becomes
   a centre, its neighbours join it, and so on among the rest.

Skew: all work is on distinct names and tokens, counted with partial aggregation.
No token makes candidates by itself, however common or rare: it takes a second one that
fits too, so what is compared are mostly variants; keys are compared in blocks.  The
rarest telling token leads, a mistyped one counting as the word it may be, so that no
word that many names hold leads where a rarer one does.  Given
names lead in names without any other telling token only, generic words never.  Equal
token sets are linked as a star around their smallest
member.  Two words that many names hold (:func:`common_from`) are never taken as one
word mistyped; what counts as many grows with the number of names.

Defined results: null and empty names take no part; names without letters or
digits are never linked; repeated rows change nothing.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import wordhash
from quern.sources.tables import materialise, release, spread

ROWS, THRESHOLD = 3, 0.85
#: A word is common if it is in more than this number of names, and more than this share of them.
COMMON, COMMON_SHARE = 250, 1 / 300
#: In :func:`variant_pairs` clusters up to this number of spellings are given as all their pairs.
MAX_PAIRS = 200

# Words that carry no identity.
DROPPED = frozenset("mr mrs ms miss dr prof professor sir dame lady lord capt captain rev hon md phd esq jr sr the of for and".split())
# Usual abbreviations in names of organisations and places.
ABBREVIATIONS = {
    "dept": "department", "univ": "university", "bk": "bank", "inst": "institute", "coll": "college", "bros": "brothers", "mfg": "manufacturing",
    "hldgs": "holdings", "ltd": "limited", "publ": "publishing", "grp": "group", "shpg": "shipping", "co": "company", "corp": "corporation",
    "inc": "incorporated", "fdn": "foundation", "assoc": "association", "assn": "association", "ath": "athletic", "athl": "athletic", "lab": "laboratory",
    "labs": "laboratory", "res": "research", "st": "saint", "ste": "saint", "mt": "mount", "ft": "fort", "pt": "port", "vly": "valley", "jct": "junction",
    "upr": "upper", "lwr": "lower", "lk": "lake", "nth": "north", "sth": "south", "intl": "international", "natl": "national", "arch": "archive", "consort": "consortium",
}
# Words that tell one place, organisation or event from its neighbours.
FIXED_WORDS = frozenset(ABBREVIATIONS.values()) | frozenset("north south east west lake falls bay sons congress prize theorem island hill river old new great little".split())
# One-letter abbreviations of place words.
PLACE_LETTERS = {"l": "lake", "n": "north", "s": "south", "e": "east", "w": "west"}
# Usual short and other forms of given names.
NICKNAMES = {
    "alexander": "alex sandy sasha xander al lex", "anthony": "tony antony", "benjamin": "ben benny", "charles": "charlie chuck chas", "daniel": "dan danny", "dmitri": "dmitry dimitri",
    "dorothy": "dot dolly dottie", "edward": "ed eddie ted ned", "edwina": "ed winnie", "eleanor": "nell ellie nora ellen elinor", "elizabeth": "liz beth betty eliza lizzie",
    "frances": "fran francie", "gabriel": "gabe", "harold": "hal harry", "isabella": "bella izzy izabella isabel", "jacob": "jake",
    "james": "jim jimmy", "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey", "katherine": "kate kathy katie kat catherine kathryn",
    "leonard": "len leo lenny", "margaret": "maggie meg peggy marge", "matthew": "matt", "michael": "mike mick mickey", "nathaniel": "nate nat nathan",
    "nicholas": "nick nicky nicolas", "oskar": "oscar", "patricia": "pat patty tricia trish", "penelope": "penny", "philip": "phil phillip", "rebecca": "becky becca",
    "richard": "rick dick rich", "robert": "bob rob bobby bert", "samuel": "sam sammy", "stephen": "steve steven stevie", "susan": "sue suzie susie",
    "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim timmy", "tobias": "toby", "tomasz": "tomas", "victoria": "vicky tori vic", "walter": "walt wally",
    "william": "bill will billy liam", "zachary": "zack zach zachery zak",
}
# Kinds of the type column, as it is spelled in several ways.
KINDS = {"person": "p", "human": "p", "people": "p", "organization": "o", "organisation": "o", "org": "o", "company": "o", "location": "l", "loc": "l", "place": "l", "city": "l"}
_DIGITS = str.maketrans("0135", "oles")


def bands_for(similarity: float, recall: float, rows: int = ROWS) -> int:
    """Bands needed so that pairs of this similarity collide with this probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


#: Letters from which a token may hold two errors, and letters up to which all that deletions leave are keys.
TWO, LONG = 9, 24
#: Keys of one bucket, which are compared in memory, and pairs made at once.
_BUCKET, _AT_ONCE = 500_000, 1_000_000


def tokens_of(name: str) -> list[str]:
    """The identifying tokens of a name, in order."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name.replace("&", " and ")) if not unicodedata.combining(c)).lower()
    out = []
    for word in re.findall(r"[^\W_]+", plain):
        if not word.isdigit() and re.search(r"\d", word):
            word = word.translate(_DIGITS)
        word = ABBREVIATIONS.get(word, word)
        if word not in DROPPED:
            out.append(word)
    return out


def edits(a: str, b: str, most: int = 2) -> int:
    """Edit distance with transpositions, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    if len(a) == len(b) == 1:
        return 1
    if len(a) == len(b) == 2 and a == b[::-1]:
        return 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def slip(a: str, b: str) -> bool:
    """Whether two tokens can be one token typed with an error."""
    short = min(len(a), len(b))
    return short >= 4 and edits(a, b, 1) <= 1 or short >= TWO and edits(a, b, 2) <= 2


def _formals(names: dict) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for formal, short in names.items():
        for x in [formal, *short.split()]:
            out.setdefault(x, set()).add(formal)
    return out


FORMALS = _formals(NICKNAMES)


def common_from(names: int) -> int:
    """Names a word must be in more of to be common, among so many."""
    return max(COMMON, int(names * COMMON_SHARE))


def token_similarity(a: str, b: str, kinds: str, common: frozenset | set = frozenset()) -> float:
    """Similarity of two tokens; ``kinds`` are those of the two names."""
    return _token_similarity(a, b, kinds, a in common, b in common)


#: Similarities of tokens met before. A dictionary goes to the workers by value, a cached function would go by name.
_MET: dict[tuple, float] = {}


def _token_similarity(a: str, b: str, kinds: str, common_a: bool, common_b: bool) -> float:
    key = (a, b, kinds, common_a, common_b)
    found = _MET.get(key)
    if found is None:
        if len(_MET) >= 1 << 18:
            _MET.clear()
        found = _MET[key] = _compared(a, b, kinds, common_a, common_b)
    return found


def _compared(a: str, b: str, kinds: str, common_a: bool, common_b: bool) -> float:
    if a == b:
        return 1.0
    if a.isdigit() or b.isdigit():
        return 0.0
    if len(a) > 1 and len(b) > 1:
        if FORMALS.get(a, {a}) & FORMALS.get(b, {b}):
            return 0.95
        sure_a, sure_b = common_a or a in FIXED_WORDS or a in FORMALS, common_b or b in FIXED_WORDS or b in FORMALS
        if not (sure_a and sure_b) and slip(a, b):
            return 0.9
        # A formal name typed with an error against its short form.
        for x, y in ((a, b), (b, a)):
            if y in FORMALS and x not in FORMALS and any(slip(x, f) for f in FORMALS[y] if f != y):
                return 0.85
        return 0.0
    letter, word = (a, b) if len(a) == 1 else (b, a)
    if len(word) == 1:
        return 0.0
    if word in FIXED_WORDS:
        return 0.9 if PLACE_LETTERS.get(letter) == word and "p" not in kinds else 0.0
    if kinds == "ll":
        return 0.0
    return 0.9 if any(f[0] == letter for f in {word} | FORMALS.get(word, set())) else 0.0


def similarity(a: list[str], b: list[str], kinds: str = "??", common: frozenset | set = frozenset()) -> float:
    """Symmetric Monge-Elkan similarity: the smaller of the two directions.

    A full word without partner counts 0, a spare initial is ignored.  Two names
    that agree only in initials, or only in words that many names hold, score 0.
    """
    if not a or not b:
        return 0.0
    left, right, strong = {}, {}, False
    # Equal words are partners before anything else; only the others need comparing.
    for i, x in enumerate(a):
        j = next((j for j, y in enumerate(b) if y == x and j not in right), None)
        if j is not None:
            left[i] = right[j] = 1.0
            strong |= len(x) > 2 and x not in FIXED_WORDS
    spare_a, spare_b = [i for i in range(len(a)) if i not in left], [j for j in range(len(b)) if j not in right]
    options = [(s, i, j) for i in spare_a for j in spare_b if (s := _token_similarity(a[i], b[j], kinds, a[i] in common, b[j] in common)) > 0]
    # A full word that no word of the other name can be is enough.
    may_a, may_b = {i for _, i, _ in options}, {j for _, _, j in options}
    if any(i not in may_a and len(a[i]) > 1 for i in spare_a) or any(j not in may_b and len(b[j]) > 1 for j in spare_b):
        return 0.0
    options.sort(key=lambda o: (-o[0], o[1], o[2]))
    for s, i, j in options:
        if i not in left and j not in right:
            left[i] = right[j] = s
            strong |= min(len(a[i]), len(b[j])) > 2 and a[i] not in FIXED_WORDS
    if not strong:
        return 0.0
    scores = []
    for words, found in ((a, left), (b, right)):
        spare = [i for i in range(len(words)) if i not in found]
        if any(len(words[i]) > 1 for i in spare):
            return 0.0
        scores.append(sum(found.values()) / len(found))
    # A lone shared word is enough only between names of one word, and two clashing initials are not spare.
    if len(left) < 2 and max(len(a), len(b)) > 1 or len(left) < min(len(a), len(b)):
        return 0.0
    return min(scores)


def _left(codes: np.ndarray, most: int) -> np.ndarray:
    """Hashes of what is left of tokens of one length, a row each, without up to ``most`` letters (1 or 2).

    Tokens within so many errors, transpositions included, have one of these in common.
    """
    size = codes.shape[1]
    base = np.uint64(0x9E3779B97F4A7C15)
    # Of letters behind a deleted one the power falls by one: a product with the inverse.
    back = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, base)])
        sums = np.zeros((len(codes), size + 1), np.uint64)
        np.cumsum(wordhash.mix64(codes.astype(np.uint64) + np.uint64(1)) * powers, axis=1, out=sums[:, 1:])
        whole = sums[:, -1:]
        one = sums[:, :-1] + (whole - sums[:, 1:]) * back
        out = [whole, one]
        if most > 1:
            i, j = np.triu_indices(size, 1)
            out.append(sums[:, i] + (sums[:, j] - sums[:, i + 1]) * back + (whole - sums[:, j + 1]) * back * back)
        return wordhash.mix64(np.concatenate(out, axis=1))


def _pieces(token: str) -> set[str]:
    """Fifths of a long token, where they can be in a token with two errors more or less.

    Two errors touch four fifths at most, as a transposition may touch two, and move the rest by two letters at most.
    """
    out = set()
    for n in range(len(token) - 2, len(token) + 3):
        for i in range(5):
            start, end = n * i // 5, n * (i + 1) // 5
            out |= {f"{n} {i} {token[start + d : end + d]}" for d in range(-2, 3) if start + d >= 0 and end + d <= len(token)}
    return out


def _token_keys(batches):
    """Keys of tokens: what deletions leave, or pieces; tokens of up to two letters more than ``LONG`` meet all others of up to ``LONG``."""
    import zlib

    for batch in batches:
        tokens = batch.column("token").to_pylist()
        if not tokens:
            continue
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        keys, owner = [], []
        for n in np.unique(size[size <= LONG + 2]):
            own = np.flatnonzero(size == n)
            codes = np.frombuffer("".join(tokens[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n)
            left = _left(codes, 2 if n >= TWO else 1)
            keys.append(left.ravel())
            owner.append(np.repeat(own, left.shape[1]))
        for i in np.flatnonzero(size > LONG):
            left = [x.encode("utf-8", "surrogatepass") for x in sorted(_pieces(tokens[i]))]
            # Two checksums make one number.
            keys.append(wordhash.mix64(np.array([zlib.crc32(x) << 32 | zlib.adler32(x) for x in left], np.uint64)))
            owner.append(np.full(len(left), i))
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        ends = np.cumsum(np.r_[0, np.bincount(owner, minlength=len(tokens))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[np.argsort(owner, kind="stable")].view(np.int64)))], names=["cid", "keys"])


def _in_buckets(buckets: int):
    """The keys packed by bucket: six bytes each, as numbers that are close together share what is above their lowest 16 bits."""

    def run(batches):
        for batch in _token_keys(batches):
            lists = batch.column("keys")
            keys = lists.flatten().to_numpy().view(np.uint64)
            cid = np.repeat(batch.column("cid").to_numpy(), lists.value_lengths().to_numpy())
            high, bucket = cid >> 16, ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((bucket, high))
            high, bucket = high[order], bucket[order]
            starts = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (bucket[1:] != bucket[:-1])])
            ends = np.r_[starts, len(order)]
            packed = [pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x[order]))])
                      for x in (keys.astype(np.uint32), (cid & 0xFFFF).astype(np.uint16))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(high[starts]), *packed], names=["bucket", "high", "keys", "low"])

    return run


def _met(keys: np.ndarray, cid: np.ndarray):
    """Pairs ``a < b`` of numbers with one key, in arrays of bounded size."""
    order = np.lexsort((cid, keys))
    keys, cid = keys[order], cid[order]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (cid[1:] != cid[:-1])]
    keys, cid = keys[fresh], cid[fresh]
    at, step, out, held = np.arange(len(keys)), 0, [], 0
    while len(at):
        step += 1
        at = at[at + step < len(keys)]
        at = at[keys[at + step] == keys[at]]
        out.append((cid[at], cid[at + step]))
        held += len(at)
        if held and (held >= _AT_ONCE or not len(at)):
            yield tuple(np.concatenate(x) for x in zip(*out))
            out, held = [], 0


def _met_in_buckets(batches):
    """Pairs of numbers with a key in common; the rows of a bucket come one after the other."""

    def pairs(rows: list[tuple]):
        cid = [np.frombuffer(low, np.uint16).astype(np.int64) + (high << 16) for high, _, low in rows]
        for a, b in _met(np.frombuffer(b"".join(k for _, k, _ in rows), np.uint32), np.concatenate(cid)):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    now, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "high", "keys", "low"))):
            if bucket != now and rows:
                yield from pairs(rows)
                rows = []
            now = bucket
            rows.append(row)
    if rows:
        yield from pairs(rows)


def _near_tokens(coded: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of ``cid`` of tokens that share a key: all that can be one token mistyped, and few others."""
    n = F.length("token")
    keys = F.when(n > LONG, 130).otherwise(0) + F.when(n > LONG + 2, 0).when(n >= TWO, n * (n + 1) / 2 + 1).otherwise(n + 1)
    buckets = int((coded.agg(F.sum(keys)).first()[0] or 0) // _BUCKET) + coded.sparkSession.sparkContext.defaultParallelism
    packed = spread(coded.select("cid", "token")).mapInArrow(_in_buckets(buckets), "bucket int, high long, keys binary, low binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met_in_buckets, "a long, b long").distinct()


def _slips(batches):
    for batch in batches:
        ok = pa.array([slip(a, b) for a, b in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist())], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("ta", "tb", "df")], names=["ta", "tb", "df"])


def _forms(token: str, typed: list[str]) -> set[str]:
    """What the token can stand for: itself, the words it may be mistyped, formal names."""
    out = {token, *typed}
    return out | {"\x01" + f for x in out for f in FORMALS.get(x, ())}


def _leading(tokens: list[str]) -> list[str]:
    """The tokens that lead to a name: telling ones, else given names."""
    plain = [t for t in tokens if len(t) >= 3 and not t.isdigit() and t not in FIXED_WORDS and t not in FORMALS]
    return plain or [t for t in tokens if t in FORMALS and t not in FIXED_WORDS]


def _name_keys(tokens: list[str], typed: dict[str, list[str]], lead: str | None = None) -> tuple[set[str], set[str], set[str]]:
    """Keys of a name: of pairs of tokens, of a token and an initial the name has, of a token and an initial it can have.

    Linked names of more than one token have two pairs of partners, one of them
    of leading tokens.  Partners that are no initials have a form in common, so
    the names share a key of two forms; an initial meets the first letters of the
    words of the other name.  A name of one token has that alone.

    Of two forms only those with ``lead`` are taken, if there is one: a full word
    needs a partner, so whichever leading token either name takes, the forms of the
    two and of their partners make a key of both names.  If the partner of ``lead`` is
    an initial, that meets the other leading tokens.  Numbers of several digits, which
    are equal in linked names, are part of every key.
    """
    forms = {t: _forms(t, typed.get(t, [])) for t in tokens}
    both, has, can = set(), set(), set()
    for first in _leading(tokens):
        others = list(tokens)
        others.remove(first)
        for f in forms[first]:
            if not others:
                both.add(f)
            for x in others:
                if lead in (None, first):
                    both |= {"\x02".join(sorted((f, g))) for g in forms[x]}
                if len(x) == 1:
                    has.add(f + "\x03" + x)
                else:
                    letters = {v.lstrip("\x01")[0] for v in {x, *("\x01" + y for y in FORMALS.get(x, ()))}} | {c for c, w in PLACE_LETTERS.items() if w == x}
                    can |= {f + "\x03" + c for c in letters}
    numbers = " ".join(sorted(t for t in tokens if t.isdigit() and len(t) > 1))
    if numbers:
        both, has, can = ({k + "\x07" + numbers for k in keys} for keys in (both, has, can))
    return both, has, can


def _keys_of_names(batches):
    """The keys of each name as three lists; ``typed`` holds a token and what it may be on a line, one string a name."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for tokens, typed, lead in zip(*(batch.column(c).to_pylist() for c in ("tokens", "typed", "lead"))):
            known = {x: rest for x, *rest in (line.split(" ") for line in (typed.split("\n") if typed else ()))}
            for column, keys in zip(out, _name_keys(tokens.split(" "), known, lead)):
                column.append(sorted(keys))
        yield pa.RecordBatch.from_arrays([batch.column("nid"), *(pa.array(x, pa.list_(pa.string())) for x in out)], names=["nid", "both", "has", "can"])


def _links(batches):
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("ka", "kb", "xa", "xb", "ca", "cb")]
        # Tokens come as one string a name, which is far cheaper to hand over than lists.
        score = [similarity(x.split(" "), y.split(" "), p + q, {*c.split(" "), *d.split(" ")} if c or d else frozenset()) for p, q, x, y, c, d in zip(*cols)]
        ok = pa.array([s >= THRESHOLD for s in score], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok), pa.array(score, pa.float64()).filter(ok)], names=["a", "b", "score"])


def _candidates(features: DataFrame) -> DataFrame:
    """Pairs of names with a key in common; those of large keys are compared block by block."""
    from quern.llm.neardup import _candidates as pairs

    return pairs(features)


def name_links(entities: DataFrame, name_col: str = "name", type_col: str = "type") -> tuple[DataFrame, DataFrame]:
    """Distinct names ``(nid, name, n, full)`` and verified links ``(a, b, score)``.

    ``full`` tells names of at least two words from those with initials only.
    """
    @F.pandas_udf("array<string>")
    def tokenise(names):
        return names.map(tokens_of)

    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.lower(F.trim(F.col("_type")))), F.lit("?"))
    mentions = entities.select(F.col(name_col).alias("name"), F.col(type_col).alias("_type")).filter("name <> ''").select("name", kind.alias("kind"))
    counted = mentions.groupBy("name").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in "pol"])
    most = F.greatest("p", "o", "l")
    sure = (F.when(most == 0, "?").when((F.col("p") == most) & (F.col("o") < most) & (F.col("l") < most), "p")
            .when((F.col("l") == most) & (F.col("o") < most) & (F.col("p") < most), "l").when((F.col("o") == most) & (F.col("l") < most) & (F.col("p") < most), "o").otherwise("?"))
    names = materialise(counted.select(F.xxhash64("name").alias("nid"), "name", "n", sure.alias("kind"), tokenise("name").alias("tokens")).filter("size(tokens) > 0"), "names")
    held = names.select("nid", F.explode(F.array_distinct("tokens")).alias("token")).filter(F.length("token") >= 2)
    frequency = materialise(held.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "names-tokens")
    often = common_from(names.count())
    given = F.col("token").isin(sorted(set(FORMALS) - FIXED_WORDS))
    fixed = F.col("token").isin(sorted(FIXED_WORDS))
    # Fixed words and formal names take part even if no name holds them, as what a mistyped one may be.
    usual = names.sparkSession.createDataFrame([(t, 0) for t in sorted({*FORMALS, *FIXED_WORDS})], "token string, df long")
    counted = frequency.unionByName(usual.join(frequency, "token", "left_anti")).filter(~F.col("token").rlike(r"^\d+$") & (F.length("token") >= 4))
    coded = materialise(counted.select(F.monotonically_increasing_id().alias("cid"), "token", "df", (~given & ~fixed & (F.col("df") <= often)).alias("rare"), (given | fixed).alias("given")), "names-coded")
    ends = [coded.select(F.col("cid").alias(x), *[F.col(c).alias(c + x) for c in ("token", "df", "rare", "given")]) for x in "ab"]
    # Which of the two the other may be: a given name or fixed word, else the more frequent one.
    lead = F.struct("givenb", "dfb", "tokenb") > F.struct("givena", "dfa", "tokena")
    near = (_near_tokens(coded).join(ends[0], "a")
            # Two common words are never one word mistyped, but one may be a formal name mistyped, against a short form.
            .join(ends[1], "b").filter("rarea or rareb or givena <> givenb")
            # Two edits with transpositions are at most four without, one is at most two; these tests stay in the JVM and keep every slip.
            .filter((F.abs(F.length("tokena") - F.length("tokenb")) <= 2) & (F.levenshtein("tokena", "tokenb", 4) >= 0))
            .filter((F.least(F.length("tokena"), F.length("tokenb")) >= 9) | (F.levenshtein("tokena", "tokenb", 2) >= 0))
            .select(F.when(lead, F.col("tokena")).otherwise(F.col("tokenb")).alias("ta"), F.when(lead, F.col("tokenb")).otherwise(F.col("tokena")).alias("tb"),
                    F.greatest("dfa", "dfb").alias("df")).mapInArrow(_slips, "ta string, tb string, df long"))
    near = materialise(near, "names-slips")
    may = near.groupBy(F.col("ta").alias("token")).agg(F.array_join(F.collect_set("tb"), " ").alias("may"), F.max("df").alias("most"))
    telling = (F.col("df") <= often) & (F.length("token") >= 3) & ~F.col("token").rlike(r"^\d+$") & ~given & ~fixed
    lexicon = frequency.join(may, "token", "left").select("token", F.when(F.col("may").isNotNull(), F.concat_ws(" ", "token", "may")).alias("typed"), (F.col("df") > often).alias("common"),
                                                          F.when(telling, F.greatest("df", "most")).alias("weight"))
    # The common words of each name travel with it: two different common words are never one word mistyped.
    words = held.join(lexicon, "token").groupBy("nid").agg(F.array_join(F.collect_set("typed"), "\n").alias("typed"), F.min(F.when(F.col("weight").isNotNull(), F.struct("weight", "token"))).alias("lead"),
                                                           F.array_join(F.collect_set(F.when(F.col("common"), F.col("token"))), " ").alias("common"))
    known = names.join(words, "nid", "left").select("nid", F.array_join("tokens", " ").alias("tokens"), "kind", F.coalesce("common", F.lit("")).alias("common"), "typed", "lead.token")
    known = materialise(known.withColumnRenamed("token", "lead"), "names-known")
    release(frequency, coded, near)
    keyed = known.select("nid", "tokens", "typed", "lead").mapInArrow(_keys_of_names, "nid long, both array<string>, has array<string>, can array<string>")
    keyed = materialise(keyed.select("nid", *[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in ("both", "has", "can")]), "names-keyed")
    led = keyed.select(F.col("nid").alias("cid"), F.col("both").alias("keys"))
    # What meets here is linked, unless another part of the names differs.
    initials = (keyed.select(F.col("nid").alias("u"), F.explode("has").alias("key")).join(keyed.select(F.col("nid").alias("v"), F.explode("can").alias("key")), "key")
                .filter("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")))
    whole = names.select(F.array_join(F.array_sort("tokens"), " ").alias("key"), "nid")
    star = (whole.join(whole.groupBy("key").agg(F.min("nid").alias("rep")), "key").filter("nid <> rep")
            .select(F.col("rep").alias("a"), F.col("nid").alias("b")))
    pairs = star.unionByName(_candidates(led)).unionByName(initials).distinct()
    full = (pairs.join(known.select(F.col("nid").alias("a"), F.col("tokens").alias("xa"), F.col("kind").alias("ka"), F.col("common").alias("ca")), "a")
            .join(known.select(F.col("nid").alias("b"), F.col("tokens").alias("xb"), F.col("kind").alias("kb"), F.col("common").alias("cb")), "b"))
    links = materialise(full.mapInArrow(_links, "a long, b long, score double"), "names-links")
    release(keyed, known)
    full = F.size(F.filter("tokens", lambda t: F.length(t) > 1)) >= 2
    return names.select("nid", "name", "n", full.alias("full")), links


def star_clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nid, centre``: star clustering of the linked nodes.

    In each round the nodes that outrank all their free neighbours (full names
    first, then by links, mentions, id) become centres, so that an initial shared
    by two relatives joins one of them and never holds both together; free
    neighbours of centres join the best of them.  Every round assigns at least the
    highest free node of each component; the loop ends when no link between free
    nodes is left.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    rank = degree.join(nodes.select(F.col("nid").alias("a"), "n", "full"), "a").select("a", F.struct("full", "d", "n", F.col("a").alias("id")).alias("r"))
    edges = materialise(both.join(rank, "a").withColumnRenamed("r", "ra").join(rank.select(F.col("a").alias("b"), F.col("r").alias("rb")), "b"), "stars-edges")
    done = None
    while not edges.isEmpty():
        top = edges.groupBy("a").agg(F.max("rb").alias("best"), F.first("ra").alias("ra")).filter("ra > best").select(F.col("a").alias("centre"))
        joined = edges.join(top, edges["b"] == top["centre"]).groupBy("a").agg(F.max_by("b", "rb").alias("centre")).select(F.col("a").alias("nid"), "centre")
        fresh = materialise(joined.unionByName(top.select(F.col("centre").alias("nid"), "centre")), "stars-round")
        done = fresh if done is None else done.unionByName(fresh)
        taken = fresh.select(F.col("nid").alias("a"))
        edges = materialise(edges.join(taken, "a", "left_anti").join(taken.withColumnRenamed("a", "b"), "b", "left_anti"), "stars-edges")
    return done if done is not None else links.select(F.col("a").alias("nid"), F.col("b").alias("centre")).limit(0)


def variants(entities: DataFrame, name_col: str = "name", type_col: str = "type") -> DataFrame:
    """``name, centre``: every name with a variant, and the spelling its cluster is named after."""
    names, links = name_links(entities, name_col, type_col)
    clusters = star_clusters(names, links)
    return (clusters.join(names.select("nid", "name"), "nid").join(names.select(F.col("nid").alias("centre"), F.col("name").alias("centre_name")), "centre")
            .select("name", F.col("centre_name").alias("centre")))


def variant_pairs(entities: DataFrame, name_col: str = "name", type_col: str = "type") -> DataFrame:
    """``name_a, name_b``: pairs of spellings of one cluster, smaller first.

    A cluster of more than ``MAX_PAIRS`` spellings is given as a star.
    """
    found = materialise(variants(entities, name_col, type_col), "names-clusters")
    sized = found.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("centre")))
    small = sized.filter(F.col("m") <= MAX_PAIRS)
    within = small.select("centre", F.col("name").alias("name_a")).join(small.select("centre", F.col("name").alias("name_b")), "centre").filter("name_a < name_b").select("name_a", "name_b")
    star = sized.filter((F.col("m") > MAX_PAIRS) & (F.col("name") != F.col("centre"))).select(F.least("name", "centre").alias("name_a"), F.greatest("name", "centre").alias("name_b"))
    return within.unionByName(star)
