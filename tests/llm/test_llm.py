"""Operators of the subpackage against brute force, round trips and edge cases."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import knn, mixing, names, neardup, packing, q_splitting, splitting, subjects, tokens, truncation, wordhash

WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me", "na", "po", "ru", "si", "ta") for b in ("bar", "den", "fil", "gom", "hus", "jak", "lor", "mit", "nep", "rik")]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- truncation -------------------------------------------------------------

RESP = "response_id long, request_id long, source string, text string, output_tokens int"


def test_endings(spark):
    cases = {
        "A whole sentence.": "whole", "A cut sent": "open", "Stops within a quote.\"": "whole", '"Quoted whole."': "whole", "“引用。": "cut", "“引用。”": "whole", "entity<|#|>a<|#|>b<|#|>c": "cut",
        "entity<|#|>a\n<|Complete|>": "whole", '{"a": ["b"]}': "whole", '{"a": ["b"': "cut", '```json\n{"a": ["b"]}\n```': "whole", '```json\n{"a": ["b"]}': "cut", 'Here: {"a": []} Let me know.': "whole",
        'Here: {"a": []} Let me': "cut", "code\n```\nx": "cut", "Going on...": "marked", "Going on [cut]": "marked", "a list,": "cut", "中文没有结束": "open", "中文结束。": "whole"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [r for r in df.withColumn("got", truncation._ending(F.col("t"))).collect() if r["got"] != r["want"]] == []


def test_lengths(spark):
    t = 'a&<"\'\n中\r\n😀'
    got = spark.createDataFrame([(t,)], "t string").select(*[v.alias(k) for k, v in truncation.lengths(F.col("t")).items()]).first().asDict()
    import html
    import json
    assert got["chars"] == len(t) and got["utf8"] == len(t.encode()) and got["utf16"] == len(t.encode("utf-16-be")) // 2
    assert got["entities"] == len(html.escape(t, quote=False)) and got["json"] == len(json.dumps(t, ensure_ascii=False)) - 2
    assert got["crlf"] == len(t) + 1 and got["crlf_utf8"] == len(t.encode()) + 1


def test_truncated(spark):
    rng = random.Random(1)
    data, cut = [], set()
    for i in range(400):
        t = " ".join(text(rng, rng.randint(4, 12)).capitalize() + "." for _ in range(rng.randint(1, 12)))
        tok, source, limit = len(t) // 4, "lim" if i % 2 else "free", None
        if source == "lim" and len(t) > 300:
            limit = 300
        elif i % 10 == 0:
            limit = len(t) // 2
        if limit and t[limit - 1] != ".":
            t = t[:limit]
            cut.add(i)
        data.append((i, i, source, t, tok if i % 7 else None))
    extra = [(1000, 1000, "free", None, 3), (1001, 1001, "free", "  \n", 3), (1002, 1002, None, "Whole.", 0), (1003, 1003, "free", "Cut at the ca", 3)]
    df = spark.createDataFrame(data + extra + data[:20], RESP)
    req = spark.createDataFrame([(i, 500) for i in range(400)] + [(1003, 3)], "request_id long, max_tokens int")
    got = {r["response_id"]: r["reason"] for r in truncation.truncated(df, req).collect()}
    assert set(got) == cut | {1003} and got[1003] == "token cap"
    limits = truncation.storage_limits(df).filter("measure = 'chars'").collect()
    assert [(r["source"], r["size"]) for r in limits] == [("lim", 300)]
    shares = {r["source"]: r for r in truncation.truncation_shares(df, req).collect()}
    assert shares[None]["n_truncated"] == 0 and shares["lim"]["n_responses"] == 200
    none = df.limit(0)
    assert truncation.truncated(none, req).count() == 0 and truncation.truncation_shares(none, req).count() == 0


def test_limits_find_what_endings_cannot(spark):
    # Sentences of 20 characters, so that every cut at 300 falls between two: the ending is whole, only the limit tells.
    sentence = "Nineteen letters x. "
    data = [(i, i, "lim", (sentence * 30)[:300], 75) for i in range(200)] + [(300 + i, 300 + i, "lim", "Short and whole" + "x" * i + ".", 5) for i in range(150)]
    # Forty deliveries of one text are one response, no limit.
    data += [(900, 900, "free", "Delivered again and again. ", 6)] * 40 + [(901 + i, 901 + i, "free", "Whole reply" + "y" * i + ".", 5) for i in range(100)]
    df = spark.createDataFrame(data, RESP)
    req = spark.createDataFrame([(0, 500)], "request_id long, max_tokens int")
    got = {r["response_id"]: r["reason"] for r in truncation.truncated(df, req).collect()}
    assert got == {i: "storage limit" for i in range(200)}
    assert {r["size"] for r in truncation.storage_limits(df).filter("source = 'free'").collect()} == set()


# --- near duplicates --------------------------------------------------------

def shingles(t, k):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)


def test_word_hashes_match_the_definition():
    texts = ["Hello, World_2 foo-bar", "", "  ", "中文 été ÉTÉ x²", "😀 a", "𝒜 b"]
    h, n = wordhash.word_hashes(texts, wordhash.alnum_table())
    words = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    assert list(n) == [len(w) for w in words]
    flat = list(itertools.chain(*words))
    assert len({(a, b) for a, b in zip(flat, h.tolist())}) == len(set(flat)) == len(set(h.tolist()))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    docs = {}
    for i in range(150):
        base = text(rng, rng.randint(24, 80)).split()
        docs[f"d{i:03}"] = " ".join(base)
        if i % 3 == 0:
            w = list(base)
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            docs[f"e{i:03}"] = " ".join(w[5:] + w[:5])
    docs["copy1"] = docs["copy2"] = docs["copy3"] = docs["d001"]
    docs |= {"null": None, "empty": "", "short": "a b", "long": text(rng, 20_000)}
    data = [(k, v, k, 1) for k, v in docs.items()] + [("d001", docs["d001"], "again", 2)]
    df = spark.createDataFrame(data, "id string, t string, cid string, key int")
    got = {(r["id_a"], r["id_b"]) for r in neardup.near_duplicates(df, "id", "t", k=3, threshold=0.5, min_words=24).collect()}
    want = set()
    sets = {k: shingles(v, 3) for k, v in docs.items() if v}
    for a, b in itertools.combinations(sorted(sets), 2):
        (x, n), (y, m) = sets[a], sets[b]
        if min(n, m) >= 24 and 2 * len(x & y) >= len(x | y):
            want.add((a, b))
    assert got <= want and len(got) >= 0.98 * len(want) and {("copy1", "copy2"), ("copy1", "d001")} <= got
    assert neardup.near_duplicates(df.limit(0), "id", "t").count() == 0


def test_large_copy_class_is_a_star_and_blocks_are_exact(spark, monkeypatch):
    t = text(random.Random(5), 40)
    df = spark.createDataFrame([(f"c{i:04}", t) for i in range(300)], "id string, t string")
    got = neardup.near_duplicates(df, "id", "t").collect()
    assert len(got) == 299 and {r["id_a"] for r in got} == {"c0000"}
    monkeypatch.setattr(neardup, "BLOCK", 4)
    keys = spark.createDataFrame([(i, [7, i + 100]) for i in range(20)], "cid long, keys array<long>")
    assert neardup._candidates(keys).count() == 190


def test_link_counts_of_large_classes(spark):
    t = text(random.Random(5), 60).split()
    near, lone = " ".join(t[:-1]), text(random.Random(6), 60)
    data = [(f"c{i:04}", " ".join(t)) for i in range(201)] + [("n1", near), ("n2", near), ("n2", near), ("lone", lone), ("s1", "a b"), ("s2", "a b"), ("null", None)]
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in neardup.link_counts(spark.createDataFrame(data, "id string, t string"), "id", "t").collect()}
    want = {f"c{i:04}": ("c0000", 202) for i in range(201)} | {"n1": ("n1", 202), "n2": ("n1", 202), "lone": ("lone", 0), "s1": ("s1", 0), "s2": ("s1", 0), "null": (None, 0)}
    assert got == want
    few = spark.createDataFrame(data[190:], "id string, t string")
    pairs = neardup.near_duplicates(few, "id", "t").select(F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("id").count()
    assert rows(pairs, "id") == rows(neardup.link_counts(few, "id", "t").filter("n_links > 0").select("id", "n_links"), "id")


# --- splitting --------------------------------------------------------------

@pytest.mark.parametrize("seed", range(6))
def test_split_round_trip(seed):
    rng = random.Random(seed)
    t = "".join(rng.choice(["%s ", "%s. ", "%s\n", "%s.\n\n", "%s　"]) % rng.choice(WORDS) for _ in range(rng.choice([10, 240, 241, 1500])))
    spans, at = splitting.cuts(t)
    pieces = splitting.split_text(t)
    assert len(pieces) == len(at) + 1 and all(n <= 240 and len(re.findall(f"[^{splitting.SPACE}]+", p)) == n for p, n in pieces)
    whole = [t[a:b] for a, b in spans]
    got = []
    for i, (p, _) in enumerate(pieces):
        w = re.findall(f"[^{splitting.SPACE}]+", p)
        if i:
            assert w[:24] == got[-24:]
        got += w[24:] if i else w
    assert got == whole


def test_an_edit_alters_neighbouring_pieces_only():
    rng = random.Random(9)
    w = [rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(4000)]
    a = {p for p, _ in splitting.split_text(" ".join(w))}
    w[2000:2000] = ["inserted", "words"]
    b = {p for p, _ in splitting.split_text(" ".join(w))}
    assert len(b - a) <= 5


def test_split_oversized_cases(spark):
    long = " ".join(f"w{i}" for i in range(500))
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "x" * 10_000, "x"), (5, long, "x"), (6, " ".join(["y"] * 240), "x"), (7, "🙂 " * 241, "x")], "id int, t string, n_tokens string")
    out = splitting.split_oversized(df, "id", "t")
    n = {r["id"]: r["n_pieces"] for r in out.collect()}
    assert n[1] == n[2] == n[3] == n[4] == n[6] == 1 and n[5] > 2 and n[7] == 2
    with pytest.raises(ValueError):
        splitting.split_oversized(df, "id", "t", 10, 10)
    place = spark.createDataFrame([("d", i * 700, f"c{i}", j) for i in range(5) for j in range(i + 1)], "doc_id string, place int, id string, piece_no int")
    got = rows(splitting.renumber(place).select("place", "piece_no", "chunk_order_index"), "place", "piece_no")
    assert [r[2] for r in got] == list(range(15))


def test_pieces_of_chunks_without_a_time(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(300))
    schema = "chunk_id string, doc_id string, content string, tokens int, chunk_order_index int, created_at timestamp_ntz"
    spark.createDataFrame([("d::chunk-0", "d", long, 1, 0, None), ("d::chunk-0", "d", long, 1, 0, None), ("d::chunk-1", "d", "short", 1, None, None)], schema).write.parquet(f"{tmp_path}/chunks.parquet")
    out = rows(q_splitting.p4_pieces(spark, str(tmp_path)).select("chunk_id", "doc_id", "chunk_order_index", "n_tokens"), "chunk_order_index")
    assert [r[:3] for r in out] == [("d::chunk-0", "d", 0), ("d::chunk-0", "d", 1), ("d::chunk-1", "d", 2)]
    assert out[0][3] + out[1][3] == 324 and out[2][3] == 1


# --- vectors ----------------------------------------------------------------

def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 128)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = knn.rotation(128)
    assert np.allclose(turn @ turn.T, np.eye(128), atol=1e-4)
    bits, a = knn.encode(x, turn)
    q = x[:50] + 0.3 * rng.standard_normal((50, 128)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    est, dev = knn.estimate((q @ turn).astype(np.float32), bits, a)
    error = est - q @ x.T
    assert bits.shape == (500, 16) and abs(error.mean()) < 0.01 and (np.abs(error) <= 3 * dev).mean() > 0.97


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(4)
    data = []
    for f in range(150):
        c = rng.standard_normal(16)
        for j in range(4):
            data.append(("ns", f"v{f:03}{j}", (c + 0.2 * rng.standard_normal(16)).astype(np.float32).tolist(), "x"))
    data += [("ns", f"w{i}", data[0][2], "x") for i in range(9)] + [("ns", "v0000", data[0][2], "again"), ("other", "lone", data[0][2], "x")]
    data += [("ns", "null", None, "x"), ("ns", "empty", [], "x"), ("ns", "zero", [0.0] * 16, "x"), ("ns", "short", [1.0] * 8, "x"), ("ns", "nan", [float("nan")] * 16, "x")]
    df = spark.createDataFrame(data, "namespace string, id string, vector array<float>, h string")
    got = {}
    for r in knn.nearest(df, 5, 16, probes=6).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    clean = {i: np.array(v, float) for n, i, v, _ in data if n == "ns" and v and len(v) == 16 and np.isfinite(v).all() and any(v)}
    ids = sorted(clean)
    x = np.stack([clean[i] / np.linalg.norm(clean[i]) for i in ids])
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    want = {i: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-s[k, j], ids[j]))[:5]] for k, i in enumerate(ids)}
    assert set(got) == set(ids)
    assert sum(len(set(got[i].values()) & set(want[i])) for i in ids) >= 0.99 * 5 * len(ids)
    assert [got["w0"][r] for r in range(1, 6)] == want["w0"] == ["v0000", "w1", "w2", "w3", "w4"]
    assert knn.nearest(df.limit(0), 5, 16).count() == 0


# --- names ------------------------------------------------------------------

def test_name_similarity():
    t = names.tokens_of
    same = [("Dr. Elizabeth Molfros", "Liz Molfros"), ("E. Molfros", "Beth Molfros"), ("Molfros, Elizabeth", "elizabeth molfr0s"), ("Bank of Dislemas", "Bk. of DISLEMAS"), ("Hundro Publ. Grp", "Hundro Publishing Group"),
            ("Framfapot & Sons", "Framfapot and Sons"), ("St. Dunfitod", "Saint-Dunfitod"), ("Mirela Stersetot", "Mirela H. Stersetto"), ("University of Murgigan", "Murgigan, University")]
    other = [("Charles Nurvofoz", "Xenia Nurvofoz"), ("Port Dunfitod", "Fort Dunfitod"), ("Upper Jerkoboz", "Lower Jerkoboz"), ("1904 Jonverit Congress", "1905 Jonverit Congress"), ("Dromkilom Theorem", "Samuel Dromkilom"),
             ("Department of Botany, Vulmok College", "Department of Geology, Vulmok College"), ("Thomas Kolvan", "Tomasz Kolvan")]
    assert [p for p in same if names.similarity(t(p[0]), t(p[1])) < names.THRESHOLD] == []
    assert [p for p in other if names.similarity(t(p[0]), t(p[1])) >= names.THRESHOLD] == []
    assert names.similarity(t("L. Kombra"), t("Lake Kombra"), "ll") > 0.8 and names.similarity(t("L. Kombra"), t("Lake Kombra"), "pl") == 0 and names.similarity(t("L. Kombra"), t("Lower Kombra"), "ll") == 0


@pytest.mark.parametrize("a, b, d", [("abc", "abc", 0), ("abc", "acb", 1), ("abcd", "abd", 1), ("abc", "xyz", 3), ("", "ab", 2), ("kitten", "sitting", 3), ("abcdef", "badcfe", 3), ("ab", "ba", 1), ("junction", "junciton", 1)])
def test_edits(a, b, d):
    assert names.edits(a, b) == d and names.edits(b, a) == d


def test_bands_follow_the_collision_curve():
    for j in (0.4, 0.5, 0.7):
        b = names.bands_for(j, 0.95)
        assert 1 - (1 - j**names.ROWS) ** b >= 0.95 > 1 - (1 - j**names.ROWS) ** (b - 1)


def test_all_slips_of_short_tokens_are_candidates():
    rng, letters, pairs = random.Random(7), "abcdefghijklmnopqrstuvwxyz", []
    for n in (4, 5, 6, 7, 8):
        for _ in range(60):
            t, i = [rng.choice(letters) for _ in range(n)], rng.randrange(n - 1)
            for u in (t[:i] + [t[i + 1], t[i]] + t[i + 2:], t[:i] + [rng.choice(letters)] + t[i + 1:], t[:i] + [rng.choice(letters)] + t[i:]):
                pairs.append(("".join(t), "".join(u)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * len(pairs)), pa.int64()), pa.array([x for p in pairs for x in p])], names=["cid", "token"])
    keys = next(names._token_keys([batch])).column("keys").to_pylist()
    assert all(names.slip(a, b) for a, b in pairs) and all(set(keys[2 * i]) & set(keys[2 * i + 1]) for i in range(len(pairs)))


def test_variants(spark):
    people = [("Zachary Linkras", "person"), ("zack linkras", "Person"), ("Linkras, Z.", None), ("Zachary Linkrsa", "x"), ("Ingrid Linkras", "person"), ("Linkras Prize", "concept"), ("", "person"), (None, None), ("!!", "person"),
              ("Lake Vosbuk", "location"), ("L. Vosbuk", "LOC"), ("Lower Vosbuk", "place"), ("12", "x")]
    df = spark.createDataFrame([(n, k, n) for n, k in people * 2], "name string, type string, nid string")
    got = {frozenset((r["name_a"], r["name_b"])) for r in names.variant_pairs(df).collect()}
    group = ["Zachary Linkras", "zack linkras", "Linkras, Z.", "Zachary Linkrsa"]
    assert got == {frozenset(p) for p in itertools.combinations(group, 2)} | {frozenset(("Lake Vosbuk", "L. Vosbuk"))}
    assert names.variant_pairs(df.limit(0)).count() == 0


def test_variants_of_common_tokens_do_not_depend_on_the_cap(spark, monkeypatch):
    given = ["Bob", "Robert", "J.", "John", "Jonh", "Ingrid", "Mirela", "Xaviera", "Wolfganger", "Ulfganget", "Bartholomeus", "Jartholomeux"]
    people = [f"{g} Kombras" for g in given] + ["John Kombrsa", "Kombras, Robert", "Kombras", "Kombrsa", "Kombras Group", "Kombras Grp.", "James Thomas", "Jim Thomas", "James Thomass"]
    df = spark.createDataFrame([(n, "person") for n in people], "name string, type string")

    def links():
        nodes, found = names.name_links(df)
        named = {r["nid"]: r["name"] for r in nodes.collect()}
        return {frozenset((named[r["a"]], named[r["b"]])) for r in found.collect()}

    whole = links()
    monkeypatch.setattr(names, "COMMON", 3)
    got = links()
    for a, b in (("Bob Kombras", "Robert Kombras"), ("J. Kombras", "John Kombras"), ("John Kombrsa", "John Kombras"), ("Kombrsa", "Kombras"), ("Kombras Group", "Kombras Grp."), ("James Thomas", "Jim Thomas"), ("James Thomas", "James Thomass"),
                 ("Bartholomeus Kombras", "Jartholomeux Kombras")):
        assert frozenset((a, b)) in got
    assert got == whole


def _mistyped(token, rng, letters):
    """The token with one error."""
    i, kind = rng.randrange(len(token) - 1), rng.randrange(4)
    return token[:i] + (token[i + 1] + token[i] + token[i + 2:], rng.choice(letters) + token[i + 1:], rng.choice(letters) + token[i:], token[i + 1:])[kind]


def test_token_keys_meet_two_errors_and_hardly_anything_else(spark):
    rng, letters = random.Random(11), "abcdefghijklmnopqrstuvwxyzå"
    syllables = ["".join(x) for x in itertools.product("klmrst", "aeiou", "fmnst")]
    tokens = {"".join(rng.choice(syllables) for _ in range(rng.randrange(3, 5))) for _ in range(700)}
    tokens |= {"".join(rng.choice(letters) for _ in range(n)) for n in range(9, 45) for _ in range(6)}
    tokens |= {_mistyped(_mistyped(t, rng, letters), rng, letters) for t in sorted(tokens)[::3]}
    tokens = sorted(tokens)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(tokens)), pa.int64()), pa.array(tokens)], names=["cid", "token"])
    holders = {}
    for i, keys in enumerate(next(names._token_keys([batch])).column("keys").to_pylist()):
        for k in set(keys):
            holders.setdefault(k, []).append(i)
    met = {p for own in holders.values() for p in itertools.combinations(own, 2)}
    true = {(i, j) for i, j in itertools.combinations(range(len(tokens)), 2) if abs(len(tokens[i]) - len(tokens[j])) <= 2 and names.slip(tokens[i], tokens[j])}
    assert len(true) > 250 and true <= met and len(met) < 8 * len(true)
    # The packed way gives the same pairs, however far apart the numbers are, and a few of which only half the key is equal.
    coded = spark.createDataFrame([(i * 9_999 - 70_000, t) for i, t in enumerate(tokens)], "cid long, token string").repartition(3)
    got = {((r["a"] + 70_000) // 9_999, (r["b"] + 70_000) // 9_999) for r in names._near_tokens(coded).collect()}
    assert met <= got and len(got - met) < 20
    assert names._near_tokens(coded.limit(0)).count() == 0


def test_names_that_share_common_words_only_are_not_compared(spark, monkeypatch):
    rng = random.Random(3)
    rare = ["".join(rng.choice("bdfghjklmnprstvwz") + rng.choice("aeiou") for _ in range(4)) for _ in range(40)]
    given = [f"Department of Linguistics, {t.title()} College" for t in rare] + [f"Xenia {t.title()}" for t in rare] + [f"{y} {rare[0].title()} Congress" for y in range(1900, 1940)]
    pairs = [("Dept. of Linguistics, Vulmokar Coll.", "Department of Linguistisc, Vulmokar College"), ("Xenia Vulmokar", "Xenai Vulmoakr"), ("1950 Vulmokar Congress", "1950 Vulmokra Congress"), ("Glesfafuv Foundation", "Glusfafud Foundation")]
    df = spark.createDataFrame([(n, None) for n in [*given, *(n for p in pairs for n in p)]], "name string, type string")

    def candidates(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array([1.0] * b.num_rows, pa.float64())], names=["a", "b", "score"])

    def links():
        nodes, found = names.name_links(df)
        named = {r["nid"]: r["name"] for r in nodes.collect()}
        return {frozenset((named[r["a"]], named[r["b"]])) for r in found.collect()}

    assert {frozenset(p) for p in pairs} <= links()
    monkeypatch.setattr(names, "_links", candidates)
    assert len(links()) < 60  # 80 departments or persons and 40 congresses make 2,340 pairs


# --- packing and mixing -----------------------------------------------------

@pytest.mark.parametrize("seed", range(5))
def test_packing_uses_every_item_once(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, rng.choice([5, 60, 100])) for _ in range(rng.choice([1, 30, 400]))]
    counts = {x: sizes.count(x) for x in sizes}
    out = packing.pack_sizes(counts, 100)
    assert sorted(x for w in out for x in w) == sorted(sizes) and all(sum(w) <= 100 for w in out)
    assert len(out) <= -(-sum(sizes) // 100) + max(1, sum(x > 50 for x in sizes))


def test_complements_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 2) for _ in range(6)}
        s, gap = packing.Sizes(counts, 64), rng.randint(1, 64)
        items = [x for x, n in counts.items() for _ in range(n)]
        want = any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(items, k))
        got = s.complement(gap)
        assert bool(got) == want and (not got or sum(got) == gap and all(got.count(x) <= counts[x] for x in got))


def test_pack_table(spark):
    df = spark.createDataFrame([(1, 5000, "x"), (2, 10, "x"), (3, 0, "x"), (4, None, "x"), (5, 2048, "x")] + [(i, 100 + i, "x") for i in range(10, 60)], "id int, size int, shard string")
    out = packing.pack(df, "id", "size", 2048, 20).collect()
    assert {r["id"] for r in out} == {1, 2, 5} | set(range(10, 60))
    assert [(r["first_token"], r["n_tokens"]) for r in sorted(out, key=lambda r: r["piece_no"]) if r["id"] == 1] == [(0, 2048), (2048, 2048), (4096, 904)]
    load = {}
    for r in out:
        load[r["window_id"]] = load.get(r["window_id"], 0) + r["n_tokens"]
    assert max(load.values()) <= 2048
    assert packing.pack(df.limit(0), "id", "size").count() == 0


def test_permutations():
    for n in (1, 2, 3, 10, 1000, 4097):
        out = mixing.permute(np.arange(n), np.int64(n), np.int64(5))
        assert sorted(out.tolist()) == list(range(n))
    assert mixing.permute(np.arange(1000), np.int64(1000), np.int64(5)).tolist() != mixing.permute(np.arange(1000), np.int64(1000), np.int64(6)).tolist()


def test_mixing(spark):
    rng = random.Random(8)
    docs = [(i, text(rng, rng.randint(1, 300)), ["a", "b", "b", "b", "c", None][i % 6], 0) for i in range(300)]
    docs += [(900, docs[0][1], "a", 0), (901, "", "a", 0), (902, None, "a", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, first int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 3), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    sel = mixing.mix(df, targets)
    out = {r["source"]: r for r in mixing.shares(sel, targets).collect()}
    for s, want in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert abs(out[s]["reached_share"] - want) < 0.02 and out[s]["most_uses"] <= out[s]["max_repeats"]
    assert out["gone"]["n_tokens"] == 0 and sel.filter("doc_id in (900, 901, 902)").count() == 0
    parts = sel.groupBy("doc_id", "repetition").agg(F.sum("n_tokens").alias("n")).join(tokens.token_sizes(df, ["doc_id"]), "doc_id")
    assert parts.filter("n > n_tokens").count() == 0
    assert mixing.mix(df.limit(0), targets).count() == 0


def test_slots_are_drawn_by_shard_and_exact_in_total(spark):
    available, wanted = np.array([40, 7000, 900]), np.array([100, 5000, 900])
    out = mixing._slots(spark, ["a", "b", "c"], available, wanted, 3).toPandas()
    assert sorted(out["slot_no"]) == list(range(6000)) and out.groupby("source").size().to_dict() == {"a": 100, "b": 5000, "c": 900}
    assert not out.duplicated(["source", "repetition", "block_no"]).any() and (out["block_no"] < out["source"].map(dict(zip("abc", available)))).all()
    assert out[out["source"] == "a"]["repetition"].max() == 2
    # The draws vary by shard and follow the shares.
    drawn = out[out["source"] == "c"].groupby("shard_no").size()
    assert drawn.nunique() > 1 and (abs(drawn.iloc[:-1] - 1024 * 0.15) < 60).all()


def test_cuts_below_the_least_size_only_without_boundary_in_reach():
    # The only sentence end lies after 60 tokens, below the least size of 100.
    t = " ".join(["w"] * 59 + ["end."] + ["w"] * 400)
    assert splitting.cuts(t)[1][0] == 60
    assert 100 <= splitting.cuts(" ".join(["w"] * 500))[1][0] <= 216
    assert splitting.cuts(" ".join(["w"] * 9 + ["end."] + ["w"] * 400))[1][0] >= 100


# --- subjects ---------------------------------------------------------------

def test_statements():
    t = ("# Heading\nDr. Who came at no. 41.4 today. Second one!\nuser: Skip me.\nassistant: Keep me. And me?\n- Listed point.\nReferences: [chunk-1]\n## More\n"
         'entity<|#|>N<|#|>t<|#|>A fact.\n<|COMPLETE|>\n{"Description": "In JSON."}\n中文一句。又一句。')
    assert subjects.sections(t) == [["Dr. Who came at no. 41.4 today.", "Second one!", "Keep me.", "And me?", "Listed point."], ["A fact.", "In JSON.", "中文一句。", "又一句。"]]
    assert subjects.sections("") == [] and subjects.features("Ab c 中文字") == ["ab", "中文", "文字"]


def test_latent_model_learns_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.3
    votes = np.stack([np.where(rng.random(len(y)) < acc, y, ~y).astype(int) for acc in (0.9, 0.8, 0.7)], axis=1)
    pats, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = subjects.latent_posterior(pats, counts.astype(float), pats.mean(axis=1), np.zeros(len(pats), bool))
    assert ((p[inverse.ravel()] >= 0.5) == y).mean() > 0.9


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(6)
    vocabulary = {"law": WORDS[:20], "sport": WORDS[20:40], "farming": WORDS[40:60]}
    plain = WORDS[60:]

    def document(mix):
        out = []
        for s in mix:
            own = vocabulary.get(s, plain)
            out.append(" ".join([rng.choice(own), rng.choice(plain), rng.choice(own), "the", rng.choice(own)]).capitalize() + ".")
        return " ".join(out)

    docs, truth, labels = [], {}, []
    for i in range(400):
        kinds = rng.sample(list(vocabulary), rng.choice([0, 1, 1, 2]))
        mix = [k for k in kinds for _ in range(5)] + ["none"] * (3 if kinds else 6)
        truth[i] = {k for k in kinds if 5 / len(mix) >= 0.2}
        docs.append((i, document(mix), "src", "a/b.txt"))
        if i % 4 == 0:
            given = truth[i] if rng.random() > 0.1 else {"law"}
            labels += [(i, s) for s in given] + [(i, s) for s in given]
    docs += [(900, None, None, None), (901, " ", None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, file_path string")
    names_of = spark.createDataFrame([(s, "") for s in vocabulary], "subject string, note string")
    got = {}
    for r in subjects.document_subjects(df, spark.createDataFrame(labels, "doc_id long, subject string"), names_of).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held = [i for i in truth if i % 4]
    assert sum(got.get(i, set()) == truth[i] for i in held) >= 0.95 * len(held) and not {900, 901} & set(got)
    assert subjects.document_subjects(df.limit(0), spark.createDataFrame(labels, "doc_id long, subject string"), names_of).count() == 0


def test_dependent_votes_count_once():
    # Two functions that always say the same are no more evidence than one; a stated accuracy keeps a function from being outvoted.
    pats = np.array([[0, 1, 1], [1, 1, 1], [0, 0, 0], [1, 0, 0]])
    counts = np.array([150.0, 850.0, 850.0, 150.0])
    start = np.eye(2)[pats[:, 0]] * 0.98 + 0.01
    grouped = subjects.latent_posterior(pats, counts, start, np.zeros(4, bool), groups=[[0], [1, 2]], trust={0: 0.999})
    assert grouped[0, 0] > 0.95 and grouped[3, 1] > 0.95
    alone = subjects.latent_posterior(pats, counts, start, np.zeros(4, bool), groups=[[0], [1], [2]])
    assert alone[0, 0] < grouped[0, 0]


def test_context_decides_statements_of_unknown_words(spark):
    # "zzz qqq" is in no labelled document: the section it stands in gives it its subject.
    law, sport = "Court judge verdict appeal.", "Match goal striker league."
    docs = [(i, f"{law if i % 2 else sport} {law if i % 2 else sport} {law if i % 2 else sport}", "a", "x/y") for i in range(200)]
    docs += [(500, f"{law} Zzz qqq. Xxx www. Vvv uuu. Ttt sss.\n# Next\n{law} {law} {sport}", None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, file_path string")
    labels = spark.createDataFrame([(i, "law" if i % 2 else "sport") for i in range(200)], "doc_id long, subject string")
    def share(use):
        return {r["subject"]: r["share"] for r in subjects.subject_votes(df, labels, ["law", "sport"], use=use).filter("doc_id = 500").collect()}
    assert share(subjects.VOTES)["law"] > share(("lexicon",))["law"]


def test_worker_functions_need_no_package(tmp_path):
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    functions = [names._links, names._keys_of_names, names._slips, names._token_keys, subjects._parse, subjects._count_patterns(3), neardup._features(5, 5, 4, 4), neardup._chain_blocks(4, 4, 8),
                 neardup._hamming(3, 0.5)]
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(functions))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import pickle, sys\nfor f in pickle.load(open('f.pkl', 'rb')): list(f(iter([])))\nassert 'quern' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
