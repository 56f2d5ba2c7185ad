"""Registered queries of the operators in this subpackage, and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import get, lit, sha2

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = lambda spark, folder: build(configure(spark), folder)
        QUERIES[name].__doc__ = build.__doc__
        if sql is not None:
            ORACLES[name] = sql
        return build
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@register("op1_ngram_jaccard_join", rf"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    sh AS (
      SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 3], ' ')) AS s
      FROM w, UNNEST(range(1, greatest(len(ws) - 2, 2))) t(i) WHERE len(ws) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    sized AS (SELECT a, b, c, x.n AS na, y.n AS nb FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b),
    links AS (SELECT a, b FROM sized WHERE 100 * c >= 85 * (na + nb - c)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
    SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id,
           least(d.doc_id, min(e.b)) AS class_id
    FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    LEFT JOIN (SELECT a, b FROM sized WHERE c = na AND c = nb) e ON e.a = d.doc_id GROUP BY d.doc_id""")
def _(spark, folder):
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85."""
    from .ngram_join import ngram_components
    return ngram_components(table(spark, folder, "documents"), size=4, threshold=0.85).select(
        "doc_id", "n_shingles", "component_id", "class_id")


@register("op1_ngram_jaccard_links", ORACLES["op1_ngram_jaccard_join"].replace(
    " AS class_id\n", " AS class_id,\n           coalesce(any_value(k.n_links), 0) AS n_links\n").replace(
    "e ON e.a = d.doc_id GROUP BY", "e ON e.a = d.doc_id\n    LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) k ON k.a = d.doc_id GROUP BY"))
def _(spark, folder):
    """The same components, with every document's number of links."""
    from .ngram_join import ngram_components
    return ngram_components(table(spark, folder, "documents"), size=4, threshold=0.85)


@register("op9_suffix_array_dedup", """
    WITH h AS (SELECT doc_id, encode(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents),
    win AS (SELECT doc_id, i, x[i + 1:i + 50] AS s FROM h, UNNEST(range(0, n - 49)) t(i) WHERE n >= 50),
    firsts AS (SELECT s, min(doc_id) AS m FROM win GROUP BY 1),
    hit AS (SELECT doc_id, i FROM win JOIN firsts USING (s) WHERE doc_id > m),
    grouped AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
      SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit)),
    span AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM grouped GROUP BY doc_id, g),
    cut AS (SELECT doc_id, s AS pos, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b, e - s AS gone FROM span
      UNION ALL SELECT h.doc_id, n, coalesce(max(e), 0), n, 0 FROM h LEFT JOIN span USING (doc_id) GROUP BY h.doc_id, n)
    SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans,
           sha256(unhex(string_agg(hex(x[a + 1:b]), '' ORDER BY pos, gone DESC))) AS kept_sha256
    FROM cut JOIN h USING (doc_id) GROUP BY doc_id""")
def _(spark, folder):
    """Documents without the 50-byte strings that start in earlier documents."""
    from .suffix_dedup import remove_repeats
    return remove_repeats(table(spark, folder, "documents"), 50).drop("spans")


@register("op5_prefix_sum_shards")
def _(spark, folder):
    """All documents in 16 contiguous shards of nearly equal bytes."""
    from .sharding import shard_documents
    return shard_documents(table(spark, folder, "documents"), 16)


def _sql_rule(path: str, what: int) -> str:
    """The rule (0) or verdict (1) of a host and a path; the longest come first."""
    rules = (("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block"))
    return "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, v)[what]}'" for h, p, v in rules) + " END"


# The given pages have no canonical or refreshing links: an alias differs from a url in fragment
# and scheme, and in an empty path that stands for the root.
@register("op6_redirect_filter", rf"""
    WITH p AS (
      SELECT page_id, contains(url, '://') AS known,
             coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
    SELECT page_id, host, path, {_sql_rule('path', 0)} AS rule,
           coalesce({_sql_rule('path', 1)}, CASE WHEN known AND path = '' THEN {_sql_rule("'/'", 1)} END, 'allow') AS verdict FROM p""")
def _(spark, folder):
    """The rule and verdict of every page's url."""
    from .url_filter import judge_pages
    return judge_pages(table(spark, folder, "pages"))


@register("op7_splitting_tree_mix")
def _(spark, folder):
    """How often a mix of 150 % of all words takes each document, and the shards that the tree deals it to."""
    from .mixing import mixture
    plan, _ = mixture(table(spark, folder, "documents"))
    dealt = [get("dealt", lit(k)).alias(name) for k, name in ((0, "first_shard"), (1, "second_shard"))]
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken", *dealt)


_CAPITALS = "".join(map(chr, range(0xC0, 0xDF)))
_SMALL = "".join(chr(ord(c) + 32) for c in _CAPITALS)
_LETTERS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}{_CAPITALS}', '{_LOWER}{_SMALL}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"


@register("op8_benchmark_decontamination", f"""
    WITH d AS (SELECT doc_id, len(ws) AS n, UNNEST(ws) AS w, UNNEST(range(len(ws))) AS p FROM (SELECT doc_id, {_LETTERS} AS ws FROM documents)),
    b AS (SELECT item_id, len(ws) AS m, least(len(ws), 20) AS need, UNNEST(ws) AS w, UNNEST(range(len(ws))) AS j
          FROM (SELECT item_id, {_LETTERS} AS ws FROM benchmark) WHERE len(ws) >= 1),
    same AS (SELECT doc_id, item_id, p - j AS shift, j, n, m, need FROM d JOIN b ON d.w = b.w
             QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, p - j) * 100 >= 80 * need),
    windows AS (SELECT doc_id, item_id, shift, need, s, count(*) AS n_equal FROM same, UNNEST(range(j - need + 1, j + 1)) t(s)
                WHERE s >= 0 AND s + need <= m AND shift + s >= 0 AND shift + s + need <= n GROUP BY ALL)
    SELECT doc_id, item_id, CAST(shift + s AS BIGINT) AS at_word, CAST(need AS BIGINT) AS n_words, n_equal FROM windows
    WHERE 100 * n_equal >= 80 * need
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, shift + s) = 1""")
def _(spark, folder):
    """Documents that hold passages of benchmark items, replaced words tolerated."""
    from .decontaminate import leaks
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register("op10_document_fingerprints")
def _(spark, folder):
    """Fingerprints of all documents, of their edited texts, and their likeness."""
    from .fingerprints import edit_probe
    return edit_probe(table(spark, folder, "documents"))


PROBE = "</s>[INST] ok [/INST]"
_SHA = "lower(sha256(coalesce(string_agg({0}, '' ORDER BY turn, role, text), '')))"
_ESCAPES = r"length(regexp_replace(text, '(<(?:s>|/s>|\||/?SYS)|\[(?:/?INST\]|/?ROLE\])|\\)', '\1+', 'g'))"


@register("op4_chat_parts", f"""
    WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
    SELECT conv_id, count(*) AS n_turns, {_SHA.format("role || chr(10) || text || chr(10)")} AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        {_SHA.format("CASE WHEN role = 'assistant' THEN text ELSE '' END")} AS loss_sha256,
        CAST(sum({_ESCAPES} + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 ELSE length(role) + 22 END) AS BIGINT) AS formatted_chars,
        CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS part_tokens
    FROM m GROUP BY conv_id""")
def _(spark, folder):
    """Digests of all formatted conversations, read back, and of one that holds control strings."""
    from .chat_format import conversation_digests, format_messages, text_part
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return conversation_digests(format_messages(rows.withColumn("content", text_part(rows["text"]))))


@register("op3_kernel_toxicity")
def _(spark, folder):
    """A toxicity score of every document, from a string-kernel machine trained on labelled ones."""
    from .toxicity import toxicity
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


#: A public vocabulary and an id that it leaves free.
VOCABULARY, END_ID = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256


@register("op2_separator_scan")
def _(spark, folder):
    """Tokens of every document, counted in flat token files made of all documents."""
    from .token_scan import document_tokens
    return document_tokens(table(spark, folder, "documents"), VOCABULARY, END_ID)


@register("op11_line_runs", rf"""
    WITH l AS (SELECT doc_id, UNNEST(string_split(coalesce(text, ''), chr(10))) AS line,
                      UNNEST(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
    k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM l),
    r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
    FROM k LEFT JOIN r USING (key) GROUP BY doc_id""")
def _(spark, folder):
    """Documents without the lines that three or more of them hold, but in the last one."""
    from .line_dedup import dedup_lines
    kept = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", sha2(kept["text"].cast("binary"), 256).alias("kept_sha256"))


# crc32 of a decimal number, bit by bit; 3988292384 is the reflected polynomial
_CRC = ("xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), "
        "lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda acc, s: CASE WHEN s >= 0 THEN xor(acc, s) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295)")


@register("op12_conversation_trie", rf"""
    WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, md5(role) || md5(text) AS k,
                 len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM m),
    c AS (SELECT conv_id, conv_id - conv_id % 20 AS donor, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM m)),
    n AS (SELECT conv_id AS donor, count(*) AS n FROM o GROUP BY 1),
    r AS (SELECT c.conv_id, o.pos, o.k, o.words FROM c JOIN o ON o.conv_id = c.donor AND o.pos < c.h
      UNION ALL SELECT conv_id, o.pos - c.h + least(c.h, coalesce(n.n, 0)), o.k, o.words
      FROM c JOIN o USING (conv_id) LEFT JOIN n USING (donor) WHERE o.pos >= c.h),
    p AS (SELECT conv_id AS member, pos + 1 AS depth, md5(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS path, words FROM r
      UNION ALL SELECT conv_id, 0, '', 0 FROM c),
    node AS (SELECT depth, path, min(member) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY 1, 2),
    own AS (SELECT p.member, p.depth, node.conv_id FROM p JOIN node USING (depth, path)),
    kin AS (SELECT node.*, own.conv_id AS parent_conv_id FROM node LEFT JOIN own ON own.member = node.conv_id AND own.depth = node.depth - 1),
    kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM kin WHERE depth > 0 GROUP BY 1, 2),
    full_ AS (SELECT kin.*, coalesce(n_children, 0) AS n_children FROM kin LEFT JOIN kids USING (conv_id, depth)),
    sub AS (SELECT own.conv_id, own.depth, sum((n_convs - 1) * words) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
            FROM full_ x JOIN own ON own.member = x.conv_id AND own.depth <= x.depth GROUP BY 1, 2),
    tail AS (SELECT conv_id, depth, sha256(string_agg(CAST(member AS VARCHAR), ',' ORDER BY member)) AS sha
             FROM own JOIN (SELECT member, max(depth) AS depth FROM p GROUP BY 1) USING (member, depth) GROUP BY 1, 2)
    SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
           coalesce(sha, sha256('')) AS ends_sha256 FROM full_ JOIN sub USING (conv_id, depth) LEFT JOIN tail USING (conv_id, depth)""")
def _(spark, folder):
    """The trie of all conversations' prefixes, with what sharing them saves."""
    from .prefix_trie import conversation_trie
    return conversation_trie(table(spark, folder, "conversations"))


@register("op13_hilbert_negatives", """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                 CAST(list_inner_product(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])) AS BIGINT) AS score
          FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.vec) = len(b.vec)),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.id AS positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
           n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 30 * p.score AND 90 * p.score
    QUALIFY rank <= 10""")
def _(spark, folder):
    """Hard negatives of every hundredth vector."""
    from .hard_negatives import hard_negatives
    return hard_negatives(table(spark, folder, "embeddings"))
