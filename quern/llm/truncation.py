"""Texts that lost their end, through a size limit or in transfer.

Lengths are taken under several encodings and escapings (characters, UTF-8 bytes,
UTF-16 units, entity-escaped, JSON-escaped, CRLF line ends).  Per source and
measure the responses are counted by length, each once however often it was
delivered; a length held by far more of them than its neighbours is a storage
limit.  A row is then judged by its ending together with
three pieces of evidence: it sits at a limit of its source, the provider counted
more tokens than the text can hold, or the count equals the request's cap.  A
whole sentence followed by space right at a limit or cap was cut between sentences.

Defined results: null and blank texts are never truncated; a null or zero token
count, a missing request or a null source is no evidence; repeated deliveries of
a row count once in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.tables import materialise

#: Neighbouring lengths on either side with which a length is compared.
NEAR = 32
#: A limit holds at least so many rows, and so many times the average of its neighbours.
SPIKE_ROWS, SPIKE_TIMES = 5, 10
#: A limit leaves few longer texts: at most so many times the rows at the limit (marks added after the cut make several limits).
MOST_BEYOND = 8
#: Bytes a counted token stands for, and the tolerated excess of the count.
BYTES_PER_TOKEN, EXCESS, EXCESS_BYTES = 4, 1.15, 12
#: Share of the open endings that a last line must have to count as a sign-off.
SIGN_OFF_SHARE = 0.02

FIELD_MARK, END_MARK, FENCE = "<|#|>", "<|complete|>", "```"


def _occurrences(text: Column, what: str) -> Column:
    """How often ``what`` occurs, overlaps not counted."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("int")


def lengths(text: Column) -> dict[str, Column]:
    """The length of a text under each encoding or escaping."""
    chars, nbytes = F.length(text), F.octet_length(text)
    ascii_only = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    entities = (_occurrences(text, "&") * 4 + (_occurrences(text, "<") + _occurrences(text, ">")) * 3)
    quotes = _occurrences(text, '"') * 5 + _occurrences(text, "'") * 5
    escapes = sum((_occurrences(text, c) for c in ('"', "\\", "\n", "\r", "\t")), F.lit(0))
    crlf = _occurrences(text, "\n") - _occurrences(text, "\r\n")
    return {
        "chars": chars, "utf8": nbytes, "utf16": (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"),
        "entities": chars + entities, "entities_quotes": chars + entities + quotes, "entities_utf8": nbytes + entities + quotes,
        "json": chars + escapes, "json_ascii": chars + escapes + (chars - ascii_only) * 5, "json_utf8": nbytes + escapes,
        "crlf": chars + crlf, "crlf_utf8": nbytes + crlf,
    }


def _sizes(text: Column) -> Column:
    """The lengths as one array, in the order of :func:`lengths`."""
    return F.array(*[v.cast("int") for v in lengths(text).values()])


def _sized(df: DataFrame) -> DataFrame:
    """The columns of ``df`` with ``measure, size`` for each length in its array ``sizes``."""
    kept = [c for c in df.columns if c != "sizes"]
    names = F.array(*[F.lit(k) for k in lengths(F.lit(""))])
    return df.select(*kept, F.posexplode("sizes").alias("m", "size")).select(*kept, F.get(names, F.col("m")).alias("measure"), "size")


def _limits(sized: DataFrame) -> DataFrame:
    counted = sized.groupBy("source", "measure", "size").agg(F.count(F.lit(1)).alias("n"))
    # One row per length is left, so a window over a source holds no more rows than there are lengths.
    near = Window.partitionBy("source", "measure").orderBy("size").rangeBetween(-NEAR, NEAR)
    around = (F.sum("n").over(near) - F.col("n")) / (2 * NEAR)
    beyond = F.sum("n").over(Window.partitionBy("source", "measure").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1))
    return (counted.withColumn("around", around).withColumn("beyond", F.coalesce(beyond, F.lit(0)))
            .filter((F.col("n") >= SPIKE_ROWS) & (F.col("n") >= SPIKE_TIMES * (F.col("around") + 0.2)) & (F.col("beyond") <= MOST_BEYOND * F.col("n")))
            .drop("around", "beyond"))


def storage_limits(df: DataFrame, source: str = "source", text: str = "text", key: str = "response_id") -> DataFrame:
    """``source, measure, size, n``: lengths at which a source cuts or stores its texts.

    Deliveries of one ``key`` with the same lengths count once; without that column
    every row counts.
    """
    rows = df.select(F.col(source).alias("source"), F.col(text).alias("_text"), *([F.col(key).alias("_key")] if key in df.columns else [])).filter("_text <> ''")
    sized = rows.withColumn("sizes", _sizes(F.col("_text"))).drop("_text")
    return _limits(_sized(sized.distinct() if "_key" in sized.columns else sized))


def _ending(t: Column) -> Column:
    """``cut``, ``whole``, ``marked`` or ``open`` for a text without trailing space.

    Records must close with their end mark, JSON and fences must balance, quotes
    opened at the start must be closed; otherwise the last character decides.
    ``marked`` ends in an ellipsis or a cut mark, ``open`` needs the last line
    compared with others.
    """
    record = t.contains(FIELD_MARK)
    even_fence = _occurrences(t, FENCE) % 2 == 0
    json = t.rlike(r'^(```\w*\s*)?[^{}\n]{0,80}\{\s*"')
    balanced = ((_occurrences(t, "{") == _occurrences(t, "}")) & (_occurrences(t, "[") == _occurrences(t, "]")) & (_occurrences(t, '"') % 2 == 0))
    closed = t.rlike(r'[.。!?！？"”’』」)\]}`>]$')
    quoted = (~t.startswith('"') | (_occurrences(t, '"') % 2 == 0)) & (~t.startswith("“") | (_occurrences(t, "“") <= _occurrences(t, "”")))
    return (F.when(record, F.when(F.lower(t).endswith(END_MARK), "whole").otherwise("cut"))
            .when(~even_fence, "cut")
            .when(json, F.when(balanced & closed, "whole").otherwise("cut"))
            .when(t.rlike(r"(\.\.\.|…|\[cut\]|\[truncated\])$"), "marked")
            .when(t.rlike("[�\\[({<,;:、，；：]$"), "cut")
            .when(closed, F.when(quoted, "whole").otherwise("cut"))
            .otherwise("open"))


def _template(line: Column) -> Column:
    """A last line with digits and capitalised words made alike."""
    return F.regexp_replace(F.regexp_replace(line, r"\d", "0"), r"\p{Lu}[\p{Ll}\p{M}]+", "X")


def _list_item(line: Column) -> Column:
    """The words of a list line after the bullet and the first word; null for other lines."""
    return F.nullif(F.lower(F.regexp_extract(line, r"^\s*(?:[-*•]|\d+[.)])\s+\S+\s+(.+?)\s*$", 1)), F.lit(""))


def truncated(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """``response_id, source, reason`` of every response that lost its end."""
    clean = responses.select("response_id", "request_id", "source", "text", "output_tokens").withColumn("t", F.regexp_replace("text", r"(?U)\s+$", "")).filter("t <> ''")
    line = F.element_at(F.split("t", "\n"), -1)
    judged = clean.select(
        "response_id", "request_id", "source", "output_tokens", F.octet_length("text").alias("nbytes"), _ending(F.col("t")).alias("ending"),
        (F.col("text") != F.col("t")).alias("spaced"), _sizes(F.col("text")).alias("sizes"), line.alias("line"))
    judged = judged.withColumn("line", F.when(F.col("ending") == "open", F.col("line"))).withColumn("item", _list_item(F.col("line")))
    judged = judged.withColumn("template", F.when(F.col("line").isNotNull() & F.col("item").isNull(), _template(F.col("line"))))

    # Lengths and endings are taken once; what follows never reads the texts again, but for list items.
    judged = materialise(judged, "truncation-judged")
    # Re-delivered rows make no limit.
    sized = _sized(judged.select("response_id", "source", "sizes").distinct())
    limits = _limits(sized).select("source", "measure", "size")
    at = sized.join(limits, ["source", "measure", "size"], "left_semi").select("response_id").distinct().withColumn("at_limit", F.lit(True))
    # A list item is whole if it stands, followed by more text, in some response.
    inner = F.split("text", "\n")
    known = (responses.filter(F.col("text").rlike(r"\n\s*(?:[-*•]|\d+[.)])\s"))
             .select(F.explode(F.slice(inner, 1, F.size(inner) - 1)).alias("line")).select(_list_item(F.col("line")).alias("item"))
             .filter("item is not null").distinct().withColumn("known", F.lit(True)))
    opens = judged.filter("template is not null").groupBy("template").agg(F.count(F.lit(1)).alias("n"))
    total = opens.agg(F.sum("n").alias("all"))
    sign_off = (opens.filter(f"n >= {SPIKE_ROWS}").crossJoin(F.broadcast(total))  # one row
                .filter(F.col("n") >= F.col("all") * SIGN_OFF_SHARE).select("template", F.lit(True).alias("signed")))
    cap = requests.groupBy("request_id").agg(F.max("max_tokens").alias("max_tokens"))
    # Only rows with an open ending have an item or a template; no others take part in these joins.
    slim, never = judged.drop("sizes"), F.lit(None).cast("boolean")
    items = slim.filter("item is not null").join(known, "item", "left").withColumn("signed", never)
    # At most 1 / SIGN_OFF_SHARE templates.
    ended = slim.filter("template is not null").join(F.broadcast(sign_off), "template", "left").withColumn("known", never)
    rest = slim.filter("item is null and template is null").withColumn("known", never).withColumn("signed", never)
    full = items.unionByName(ended).unionByName(rest).join(at, "response_id", "left").join(cap, "request_id", "left")
    tokens = F.coalesce(F.col("output_tokens"), F.lit(0))
    lost = tokens * BYTES_PER_TOKEN > F.col("nbytes") * EXCESS + EXCESS_BYTES
    at_limit = F.coalesce("at_limit", F.lit(False))
    at_cap = (tokens > 0) & (tokens >= F.coalesce("max_tokens", F.lit(2**31 - 1)))
    open_whole = F.coalesce("known", "signed", F.lit(False))
    is_cut = (F.when(F.col("ending") == "cut", True).when(F.col("ending") == "whole", lost | (F.col("spaced") & (at_limit | at_cap)))
              .when(F.col("ending") == "marked", lost | at_limit)
              .otherwise(~open_whole | lost | (F.col("known").isNotNull() & at_limit)))
    reason = F.when(at_limit, "storage limit").when(at_cap, "token cap").when(lost, "transfer").otherwise("ending")
    return full.filter(is_cut).select("response_id", "source", reason.alias("reason")).distinct()


def truncation_shares(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """``source, n_responses, n_truncated, share`` with repeated deliveries counted once."""
    total = responses.select("response_id", "source").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n_responses"))
    cut = truncated(responses, requests).groupBy("source").agg(F.countDistinct("response_id").alias("n_truncated"))
    both = total.join(cut, total["source"].eqNullSafe(cut["source"]), "left").select(total["source"], "n_responses", F.coalesce("n_truncated", F.lit(0)).alias("n_truncated"))
    return both.withColumn("share", F.round(F.col("n_truncated") / F.col("n_responses"), 6))
