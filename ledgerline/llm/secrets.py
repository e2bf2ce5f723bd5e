"""Secret scan with multipart credential linking (native DataFrame code).

Three strong kinds are always reported.  Weak candidates (an account name, a
short password, a service address) are common in ordinary text; they are
reported only when complementary parts occur within the same scope, found by
an interval join on (document, bin of positions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, sha256_text, text_or_empty

# kind, pattern, group whose length is tested (0: the match), least length,
# role.  The order is the order of kinds that start at the same position.
# The first three are strong; in their patterns only the key words ignore
# case (value classes hold both cases already).  The key words of weak kinds may
# follow a prefix that ends in "_" (DB_USER), which stays outside the span.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, "secret"),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18, "identifier"),
    ("hex", r"[0-9a-f]{16,}", 0, 16, "secret"),
    ("ident", r"""(?i)(?<![A-Za-z0-9])(?:user(?:_?name)?|login|client_id|account_id|access_key(?:_id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+/-]+)""", 1, 3, "identifier"),
    ("phrase", r"""(?i)(?<![A-Za-z0-9])(?:pwd|pass|passphrase|credential|auth|private_key|api_?key|password|passwd|secret|token)["']?\x20*[:=]\x20*["']?([!#-&(-~]+)""", 1, 6, "secret"),
    ("endpoint", r"(?i)(?<![a-z0-9])(?:https?|s3|ftp|sftp|amqp|redis|mysql|postgres(?:ql)?|mongodb)://[A-Za-z0-9._~:/?#@&=%+-]+", 0, 8, "endpoint"),
]
STRONG = ("assign", "access", "hex")
#: Parts of one credential lie at most this many characters apart.
SCOPE = 400


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """Lengths (in characters) of the text between matches, of the matches and
    of the tested group, in order; null where nothing matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    return F.when(
        text.rlike(pattern),
        F.transform(
            F.arrays_zip(F.split(text, pattern, -1).alias("before"), found.alias("found"), tested.alias("tested")),
            lambda x: F.struct(
                F.length(x["before"]).alias("before"), F.length(x["found"]).alias("found"), F.length(x["tested"]).alias("tested")
            ),
        ),
    )


def _scan(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, digest)`` per row, and all candidates of each distinct
    (doc_id, digest): ``kind, role, at, start, end``."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).select(
        "doc_id",
        sha256_text(text).alias("digest"),
        *[_pieces(text, pattern, group).alias(kind) for kind, pattern, group, _, _ in KINDS],
    )
    rows = cut(rows)
    hits = rows.where(" or ".join(f"{k[0]} is not null" for k in KINDS)).dropDuplicates(["doc_id", "digest"])
    each = F.array(
        *[F.struct(F.lit(n).alias("at"), F.lit(k).alias("kind"), F.lit(least).alias("least"), F.lit(role).alias("role"), F.col(k).alias("pieces")) for n, (k, _, _, least, role) in enumerate(KINDS)]
    )
    upto = Window.partitionBy("doc_id", "digest", "at").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        hits.select("doc_id", "digest", F.explode(each).alias("k"))
        .select("doc_id", "digest", "k.at", "k.kind", "k.least", "k.role", F.posexplode("k.pieces").alias("i", "p"))
        .where("p.found is not null")  # the last piece is the text after the last match
        .withColumn("end", F.sum(F.col("p.before") + F.col("p.found")).over(upto))
        .where("p.tested >= least")
        .select("doc_id", "digest", "at", "kind", "role", (F.col("end") - F.col("p.found")).alias("start"), "end")
    )
    return rows.select("doc_id", "digest"), cut(spans)


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """Weak candidates whose complementary parts start within ``scope``.

    An identifier needs a secret, a secret an identifier, an endpoint both.
    Each side is first reduced to the least and greatest start of its role in
    each bin of ``scope`` characters, so a candidate meets at most three rows
    however many parts its neighbourhood has.
    """
    key = ["doc_id", "digest"]
    at_bin = F.floor(F.col("start") / scope)

    def ends(role: str):
        own = F.when(F.col("role") == role, F.col("start"))
        return F.min(own).alias(f"{role}_min"), F.max(own).alias(f"{role}_max")

    bins = (
        spans.where("role <> 'endpoint'")
        .groupBy(*[F.col(c).alias(f"b_{c}") for c in key], at_bin.alias("b_bin"))
        .agg(*ends("identifier"), *ends("secret"))
    )
    assigned = spans.where("kind = 'assign'").select(*[F.col(c).alias(f"a_{c}") for c in (*key, "start")])
    weak = spans.where(~F.col("kind").isin(*STRONG))
    twice = weak["doc_id"].eqNullSafe(assigned["a_doc_id"]) & (weak["digest"] == assigned["a_digest"]) & (weak["start"] == assigned["a_start"])
    weak = weak.join(assigned, twice, "left_anti").withColumn("bin", F.explode(F.array(at_bin - 1, at_bin, at_bin + 1)))
    near = lambda role: F.max(
        F.coalesce((F.col(f"{role}_max") >= F.col("start") - scope) & (F.col(f"{role}_min") <= F.col("start") + scope), F.lit(False))
    ).alias(role)
    on = weak["doc_id"].eqNullSafe(bins["b_doc_id"]) & (weak["digest"] == bins["b_digest"]) & (weak["bin"] == bins["b_bin"])
    return (
        weak.join(bins, on)
        .groupBy(*key, "at", "kind", "role", "start", "end")
        .agg(near("identifier"), near("secret"))
        .where("if(role = 'identifier', secret, if(role = 'secret', identifier, identifier and secret))")
        .drop("identifier", "secret")
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: ``doc_id, digest, spans``.

    ``spans`` is an array of ``(start, at, end, kind)`` sorted by start and
    then by the order of kinds; starts and ends count code points, the end is
    exclusive.  A null text counts as empty; texts without findings have an
    empty array; rows that repeat (id, text) get the same spans; null ids are
    allowed; other columns are not read.
    """
    rows, spans = _scan(docs, id_col, text_col)
    kept = spans.where(F.col("kind").isin(*STRONG)).unionByName(_linked(spans, scope))
    found = kept.groupBy(F.col("doc_id").alias("f_id"), F.col("digest").alias("f_digest")).agg(
        F.sort_array(F.collect_list(F.struct("start", "at", "end", "kind"))).alias("spans")
    )
    on = rows["doc_id"].eqNullSafe(found["f_id"]) & (rows["digest"] == found["f_digest"])
    none = F.from_json(F.lit("[]"), found.schema["spans"].dataType)
    return rows.join(found, on, "left").select("doc_id", "digest", F.coalesce("spans", none).alias("spans"))


def mask_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mask``.

    Overlapping spans are masked once.  Texts without findings (null ones
    too) are unchanged; all other columns stay as they are.
    """
    found = (
        scan_secrets(docs, id_col, text_col)
        .where(F.size("spans") > 0)
        .dropDuplicates(["doc_id", "digest"])
        .select(F.col("doc_id").alias("f_id"), F.col("digest").alias("f_digest"), "spans")
    )
    rows = docs.select(F.struct("*").alias("doc")).select(
        "doc", F.col(f"doc.{id_col}").alias("id"), sha256_text(text_or_empty(f"doc.{text_col}")).alias("digest")
    )
    on = rows["id"].eqNullSafe(found["f_id"]) & (rows["digest"] == found["f_digest"])
    text = F.col(f"doc.{text_col}").cast("string")
    # Position after the furthest span so far, before each span: spans are sorted by start.
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("to"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["to"], s["end"]).alias("to"),
            F.when(
                s["end"] > acc["to"],
                F.concat(
                    acc["out"],
                    F.when(
                        (s["start"] >= acc["to"]),
                        F.array(F.substr(text, (acc["to"] + 1).cast("int"), (s["start"] - acc["to"]).cast("int")), F.lit(mask)),
                    ).otherwise(F.array().cast("array<string>")),
                ),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
    )
    masked = F.concat(F.array_join(step["out"], ""), F.substr(text, (step["to"] + 1).cast("int"), F.length(text)))
    new = F.when(F.col("spans").isNotNull(), masked).otherwise(text)
    return rows.join(found, on, "left").select(
        *[new.alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns]
    )


# --- registered query ---------------------------------------------------------


def digest_columns(found: DataFrame) -> DataFrame:
    """The query's columns from :func:`scan_secrets`' rows."""
    strong = F.filter("spans", lambda s: s["kind"].isin(*STRONG))
    line = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in STRONG], sha256_text(line(strong)).alias("base_sha256"), line(F.col("spans")).alias("spans")
    )


def query(spark, sf_dir):
    from ledgerline.llm.common import documents

    return digest_columns(scan_secrets(documents(spark, sf_dir)))


def _either_case(pattern: str) -> str:
    """Letters of key words as classes: RE2's own case folding would also
    match letters outside ASCII."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern)


def _oracle() -> str:
    """The scan in DuckDB: spans from the lengths between matches; look-behind
    becomes a leading group that is cut off again (a value takes every
    character that could begin the next key word, so no match ends where the
    next one's leading character would be needed)."""
    edge, lead = "(?<![", "(^|[^"
    blocks = []
    for at, (kind, pattern, group, least, role) in enumerate(KINDS):
        shift = edge in pattern
        if pattern.startswith("(?i)"):
            # Only the key words (before the first separator or "://") hold letters outside classes.
            body = pattern[4:]
            stop = "://" if "://" in body else r"""["']?\x20*[:=]"""
            head, rest = body.split(stop, 1)
            if shift:
                behind, _, words = head.partition("])")
                behind = behind.replace(edge, lead).replace("[^a-z0-9", "[^A-Za-z0-9")
                head = f"{behind}]){_either_case(words)}"
            else:
                head = _either_case(head)
            pattern = head + stop + rest
        sql = pattern.replace("'", "''")
        cut_off = f"regexp_extract_all(t, '{sql}', 1)" if shift else f"list_transform(regexp_extract_all(t, '{sql}', 0), lambda x: '')"
        blocks.append(
            f"SELECT r, {at} AS place, '{kind}' AS kind, {least} AS least, '{role}' AS role, regexp_split_to_array(t, '{sql}') AS parts, "
            f"regexp_extract_all(t, '{sql}', 0) AS found, {cut_off} AS lead, "
            f"regexp_extract_all(t, '{sql}', {group + shift if group or not shift else 0}) AS tested "
            f"FROM d WHERE regexp_matches(t, '{sql}')"
        )
    near = "EXISTS (SELECT 1 FROM spans o WHERE o.r = w.r AND o.role = '{}' AND abs(o.start - w.start) <= {})"
    ident, secret = (near.format(r, SCOPE) for r in ("identifier", "secret"))
    line = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place, stop)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(blocks)}),
numbered AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM hits),
ends AS (
  SELECT r, place, kind, role, least, length(tested[i]) - if(tested[i] = found[i], length(lead[i]), 0) AS k, length(found[i]) - length(lead[i]) AS n,
         CAST(sum(length(parts[i]) + length(found[i])) OVER (PARTITION BY r, place ORDER BY i) AS BIGINT) AS stop
  FROM numbered
),
spans AS (SELECT r, place, kind, role, stop - n AS start, stop FROM ends WHERE k >= least),
kept AS (
  SELECT * FROM spans WHERE place < {len(STRONG)}
  UNION ALL
  SELECT * FROM spans w WHERE place >= {len(STRONG)}
    AND NOT EXISTS (SELECT 1 FROM spans a WHERE a.r = w.r AND a.kind = 'assign' AND a.start = w.start)
    AND CASE role WHEN 'identifier' THEN {secret} WHEN 'secret' THEN {ident} ELSE {secret} AND {ident} END
),
sums AS (
  SELECT r, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in STRONG)},
         {line} FILTER (WHERE place < {len(STRONG)}) AS base, {line} AS spans
  FROM kept GROUP BY r
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in STRONG)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN sums USING (r)
"""


ORACLE = _oracle()
