"""Registered queries: filters, joins, counts, listings, search and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, composite_key, key_head, key_tail, money_text, month_of
from ..operators import aggregates, filters, joins, listing, search, sets
from ..operators.mutate import upsert
from ..session import scratch_dir
from ..sources import keyed_files, posting_segments
from ..sources.given import GivenLedger
from .catalog import register
from .oracle import ledger_sql

SCOPED = """
scoped AS (SELECT t.*, a.space_id FROM transactions t JOIN accounts a ON a.id = t.account_id)"""
LISTED = """
listed AS (
  SELECT space_id, id, booking_date, value_date, reference, text, currency, amount, balance, approved,
         note, coalesce(category, '') AS category, account_id FROM scoped)"""
DOC = """
docs AS (
  SELECT *, CAST(amount AS VARCHAR) || ' ' || printf('%.2f', amount / 100.0::DOUBLE) || ' '
            || printf('%.2f', abs(amount) / 100.0::DOUBLE) AS amount_doc FROM transactions)"""


# ---- projections and filters --------------------------------------------------------
@register("scope_to_space", ledger_sql(
    "SELECT id, amount, account_id, space_id FROM scoped", SCOPED))
def _(led: GivenLedger) -> DataFrame:
    rows = led.transactions(text=False, balance=False).select("id", "amount", "account_id")
    return filters.scope_to_space(rows, led.accounts)


@register("filter_transactions", ledger_sql("""
    SELECT id, value_date, amount, category FROM transactions
    WHERE approved AND category = 'Transport' AND value_date BETWEEN '1996-03-01' AND '1999-06-30'"""))
def _(led: GivenLedger) -> DataFrame:
    rows = led.transactions(text=False, balance=False)
    return filters.filter_transactions(
        rows, approved=True, category="Transport", date_from="1996-03-01", date_to="1999-06-30"
    ).select("id", "value_date", "amount", "category")


@register("search_short", ledger_sql("""
    SELECT id, text, amount FROM transactions
    WHERE text ILIKE '%Ri%' OR CAST(amount AS VARCHAR) LIKE '%Ri%'
       OR printf('%.2f', amount / 100.0::DOUBLE) LIKE '%Ri%'"""))
def _(led: GivenLedger) -> DataFrame:
    return search.search_short(led.transactions(balance=False), " Ri ").select("id", "text", "amount")


@register("search_wildcard", ledger_sql("""
    SELECT id, amount FROM transactions
    WHERE text LIKE '%_9%' OR CAST(amount AS VARCHAR) LIKE '%_9%'
       OR printf('%.2f', amount / 100.0::DOUBLE) LIKE '%_9%'"""))
def _(led: GivenLedger) -> DataFrame:
    return search.search_short(led.transactions(balance=False), "_9").select("id", "amount")


@register("search_trigram", ledger_sql("""
    SELECT id, text, amount FROM docs
    WHERE contains(lower(text), 'widget/12') OR contains(amount_doc, 'widget/12')""", DOC))
def _(led: GivenLedger) -> DataFrame:
    return search.search_trigram(led.transactions(balance=False), "WIDGET/12").select(
        "id", "text", "amount")


@register("search_amount", ledger_sql("""
    SELECT id, amount FROM docs WHERE contains(lower(text), '5.2') OR contains(amount_doc, '5.2')""", DOC))
def _(led: GivenLedger) -> DataFrame:
    return search.search(led.transactions(balance=False), "5.2").select("id", "amount")


@register("search_indexed", ledger_sql("""
    SELECT id, text, amount FROM docs
    WHERE contains(lower(text), 'ring/1') OR contains(amount_doc, 'ring/1')""", DOC))
def _(led: GivenLedger) -> DataFrame:
    """Look-up in the stored index, which the first search over these files in a session writes."""
    rows = led.transactions(balance=False).select("id", "text", "amount")
    root, version = _stored_index(led, rows)
    return posting_segments.search_segments(led.spark, root, rows, version, "Ring/1")


_INDEXES: dict[tuple[str, str], str] = {}


def _stored_index(led: GivenLedger, rows: DataFrame) -> tuple[str, int]:
    """Folder of the index for a session and folder, and the version of the rows.

    The version is a hash of the names, lengths and times of the files that the rows come from, so
    that changed files are another version, for which the index is built anew.
    """
    files = led.spark.read.format("binaryFile").load(rows.inputFiles())
    version = files.agg(F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()[0]
    key = (led.spark.sparkContext.applicationId, led.folder)
    if key not in _INDEXES or not posting_segments.covered(led.spark, _INDEXES[key], version):
        root = scratch_dir(led.spark, "trigrams")
        posting_segments.create_index(led.spark, root, rows, version)
        _INDEXES[key] = root
    return _INDEXES[key], version


@register("trigram_index", ledger_sql("""
    SELECT DISTINCT id, 'text' AS field, substr(lower(text), i, 3) AS trigram
    FROM docs, range(1, length(text) - 1) r(i)
    UNION
    SELECT DISTINCT id, 'amount', substr(amount_doc, i, 3)
    FROM docs, range(1, length(amount_doc) - 1) r(i)""", DOC))
def _(led: GivenLedger) -> DataFrame:
    return search.build_trigram_index(led.transactions(balance=False))


@register("trigram_index_maintenance", ledger_sql("""
    SELECT id, count(*) AS postings FROM (
      SELECT DISTINCT id, 'text' AS field, substr(lower(text), i, 3) AS trigram
      FROM edited, range(1, length(text) - 1) r(i)
      UNION
      SELECT DISTINCT id, 'amount', substr(amount_doc, i, 3)
      FROM edited, range(1, length(amount_doc) - 1) r(i)) GROUP BY 1""", DOC, """
edited AS (
  SELECT id, amount_doc, CASE WHEN substr(id, -1) = '3' THEN 'Edited ' || id ELSE text END AS text
  FROM docs WHERE substr(id, -1) <> '4')"""))
def _(led: GivenLedger) -> DataFrame:
    """Rows ending in 3 are rewritten and rows ending in 4 deleted."""
    rows = led.transactions(balance=False).select("id", "text", "amount")
    removed = rows.where(F.substring("id", -1, 1).isin("3", "4"))
    added = rows.where(F.substring("id", -1, 1) == "3").withColumn("text", F.concat(F.lit("Edited "), "id"))
    index = search.maintain_trigram_index(search.build_trigram_index(rows), removed, added)
    return index.groupBy("id").agg(F.count(F.lit(1)).alias("postings"))


_RENUMBERED = """
edited AS (
  SELECT id, amount, amount_doc, CASE WHEN amount % 97 = 0 THEN 'Edited ' || id ELSE text END AS text
  FROM docs WHERE amount % 97 <> 1)"""


def _edited_table(led: GivenLedger) -> tuple[str, str, int]:
    """A stored table and its index after two batches of edits: its folder, the index's, and its version.

    Rows whose amount is a multiple of 97 are rewritten, then rows one above a multiple are deleted.
    """
    spark, rest = led.spark, F.col("amount") % 97
    table, index = scratch_dir(spark, "searched"), scratch_dir(spark, "segments")
    rows = led.transactions(balance=False).select("id", "text", "amount")
    version = keyed_files.create_table(spark, table, rows, ["id"], file_rows=4000)
    posting_segments.create_index(spark, index, keyed_files.read_table(spark, table), version)
    stored = keyed_files.read_table(spark, table)
    rewritten = stored.where(rest == 0).withColumn("text", F.concat(F.lit("Edited "), "id"))
    deleted = stored.where(rest == 1).select("id")
    for touched, change in ((rewritten, lambda t: upsert(t, rewritten, ["id"])),
                            (deleted, lambda t: t.join(deleted, "id", "left_anti"))):
        after = keyed_files.edit_table(spark, table, touched, change).version
        if after != version:
            posting_segments.follow_table(spark, index, table, version, after)
        version = after
    return table, index, version


@register("search_segments", ledger_sql("""
    SELECT id, text, amount FROM edited
    WHERE contains(lower(text), 'ted t1') OR contains(lower(text), 'ring/1') OR contains(amount_doc, 'ring/1')
       OR contains(amount_doc, 'ted t1')""", DOC, _RENUMBERED))
def _(led: GivenLedger) -> DataFrame:
    """Look-ups of rewritten and of untouched rows in the segments for the newest version of a stored table."""
    table, index, version = _edited_table(led)
    rows = keyed_files.read_table(led.spark, table, version)
    found = [posting_segments.search_segments(led.spark, index, rows, version, term) for term in ("ted T1", "Ring/1")]
    return found[0].unionByName(found[1]).distinct().select("id", "text", "amount")


@register("live_postings", ledger_sql("""
    SELECT id, count(*) AS postings FROM (
      SELECT DISTINCT id, 'text' AS field, substr(lower(text), i, 3) AS trigram
      FROM edited, range(1, length(text) - 1) r(i)
      UNION
      SELECT DISTINCT id, 'amount', substr(amount_doc, i, 3)
      FROM edited, range(1, length(amount_doc) - 1) r(i)) GROUP BY 1""", DOC, _RENUMBERED))
def _(led: GivenLedger) -> DataFrame:
    """What the segments hold after the edits is what a rebuild would."""
    _, index, version = _edited_table(led)
    return posting_segments.live_postings(led.spark, index, version).groupBy("id").agg(F.count(F.lit(1)).alias("postings"))


@register("document_search", """
    SELECT doc_id AS id FROM documents
    WHERE contains(lower(text), 'ation') OR contains(CAST(n_chars AS VARCHAR) || ' '
      || printf('%.2f', n_chars / 100.0::DOUBLE), 'ation')""")
def _(led: GivenLedger) -> DataFrame:
    """The same search over a corpus of long texts."""
    rows = led.read("documents").select(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("amount"))
    return search.search_indexed(search.build_trigram_index(rows), rows, "ation").select("id")


@register("project_listing", ledger_sql("""
    SELECT id, booking_date, value_date, reference, text, currency, amount, balance, approved, note,
           coalesce(category, '') AS category, account_id FROM transactions"""))
def _(led: GivenLedger) -> DataFrame:
    return filters.project_listing(led.transactions())


@register("project_users", ledger_sql(
    "SELECT id, name, pin_hash IS NOT NULL AS has_pin, created_at, updated_at FROM users"))
def _(led: GivenLedger) -> DataFrame:
    return filters.project_users(led.users)


@register("check_ownership", ledger_sql("""
    SELECT s.account_id, s.month, s.space_id,
           EXISTS (SELECT 1 FROM accounts a WHERE a.id = s.account_id AND a.space_id = s.space_id) AS accepted
    FROM (SELECT *, 's' || (CAST(substr(account_id, 2) AS BIGINT) % 5) AS space_id FROM account_summaries) s"""))
def _(led: GivenLedger) -> DataFrame:
    batch = led.account_summaries.withColumn("space_id", F.concat(
        F.lit("s"), (F.substr("account_id", F.lit(2)).cast("bigint") % 5).cast("string")))
    accepted, rejected = filters.check_ownership(batch, led.accounts)
    names = ["account_id", "month", "space_id"]
    return accepted.select(*names, F.lit(True).alias("accepted")).unionByName(
        rejected.select(*names, F.lit(False).alias("accepted")))


@register("check_role", ledger_sql("""
    SELECT r.space_id, r.user_id, (SELECT count(*) FROM space_members m WHERE m.space_id = r.space_id
             AND m.user_id = r.user_id AND m.role = 'owner') > 0 AS accepted
    FROM (SELECT 's' || (c_custkey % 5) AS space_id, 'u' || c_custkey AS user_id FROM customer) r"""))
def _(led: GivenLedger) -> DataFrame:
    key = F.col("c_custkey")
    requests = led.read("customer").select(
        F.concat(F.lit("s"), (key % 5).cast("string")).alias("space_id"),
        F.concat(F.lit("u"), key.cast("string")).alias("user_id"))
    accepted, rejected = filters.check_role(requests, led.space_members, owner_only=True)
    return accepted.withColumn("accepted", F.lit(True)).unionByName(
        rejected.withColumn("accepted", F.lit(False)))


@register("spaces_of_users", ledger_sql("""
    SELECT m.space_id, m.user_id, m.role, s.name, s.created_at, s.updated_at
    FROM space_members m JOIN spaces s ON s.id = m.space_id WHERE s.id <> 's2'"""))
def _(led: GivenLedger) -> DataFrame:
    """Visible spaces only: one space is marked deleted here."""
    spaces = led.spaces.withColumn("deleted", F.col("id") == "s2")
    return joins.spaces_of_users(spaces, led.space_members)


@register("approved_labelled", ledger_sql("""
    SELECT id, category FROM transactions WHERE approved AND category IS NOT NULL AND category <> ''"""))
def _(led: GivenLedger) -> DataFrame:
    return filters.approved_labelled(led.transactions(text=False, balance=False)).select("id", "category")


@register("ids_in", ledger_sql("""
    SELECT id, amount FROM transactions
    WHERE id IN (SELECT 't' || l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""))
def _(led: GivenLedger) -> DataFrame:
    """Id lists arrive as JSON arrays, one for each returned line."""
    bindings = led.read("lineitem").where("l_returnflag = 'R'").select(F.to_json(F.array(
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")), F.lit("unknown"))).alias("ids"))
    rows = led.transactions(text=False, balance=False).select("id", "amount")
    return filters.ids_in(rows, filters.ids_from_json(bindings, "ids"))


# ---- joins --------------------------------------------------------------------------
@register("summaries_with_accounts", ledger_sql("""
    SELECT s.month, s.account_id, s.balance, a.name AS account_name, a.space_id
    FROM account_summaries s JOIN accounts a ON a.id = s.account_id"""))
def _(led: GivenLedger) -> DataFrame:
    return joins.summaries_with_accounts(led.account_summaries, led.accounts)


@register("member_roster", ledger_sql("""
    SELECT m.space_id, m.user_id, u.name, m.role, m.joined_at
    FROM space_members m JOIN users u ON u.id = m.user_id"""))
def _(led: GivenLedger) -> DataFrame:
    return joins.member_roster(led.space_members, led.users)


@register("devices_with_space", ledger_sql("""
    SELECT d.id, d.device_id, d.space_id FROM trusted_devices d JOIN spaces s ON s.id = d.space_id
    WHERE s.id <> 's1'"""))
def _(led: GivenLedger) -> DataFrame:
    spaces = led.spaces.where("id <> 's1'")
    return joins.devices_with_space(led.trusted_devices, spaces).select("id", "device_id", "space_id")


@register("enabled_device_ids", ledger_sql(
    "SELECT DISTINCT device_id FROM trusted_devices WHERE sync_enabled"))
def _(led: GivenLedger) -> DataFrame:
    return joins.enabled_device_ids(led.trusted_devices)


@register("keep_matching", ledger_sql("""
    SELECT id, account_id FROM transactions
    WHERE account_id IN (SELECT id FROM accounts WHERE space_id = 's1')"""))
def _(led: GivenLedger) -> DataFrame:
    rows = led.transactions(text=False, balance=False).select("id", "account_id")
    wanted = led.accounts.where("space_id = 's1'").select(F.col("id").alias("account_id"))
    return joins.keep_matching(rows, wanted, ["account_id"])


@register("keep_unmatched", ledger_sql("""
    SELECT id, name FROM accounts WHERE id NOT IN (SELECT account_id FROM account_summaries)"""))
def _(led: GivenLedger) -> DataFrame:
    summaries = led.account_summaries.select(F.col("account_id").alias("id"))
    return joins.keep_unmatched(led.accounts.select("id", "name"), summaries, ["id"])


@register("peer_progress", ledger_sql("""
    SELECT d.space_id, d.device_id, d.sync_enabled, coalesce(c.last_seq, -1) AS last_seq
    FROM trusted_devices d LEFT JOIN sync_cursors c
      ON c.space_id = d.space_id AND c.peer_device_id = d.device_id"""))
def _(led: GivenLedger) -> DataFrame:
    return joins.peer_progress(led.trusted_devices, led.sync_cursors)


@register("latest_other_author", ledger_sql("""
    SELECT l.id, o.device_id AS other_device_id, o.changed_at AS other_changed_at
    FROM change_log l LEFT JOIN best b ON b.row_id = l.row_id AND b.device_id = l.device_id
    LEFT JOIN change_log o ON o.id = b.other""", """
best AS (
  SELECT k.row_id, k.device_id, (SELECT o.id FROM change_log o
    WHERE o.row_id = k.row_id AND o.device_id <> k.device_id
    ORDER BY o.changed_at DESC, o.seq DESC LIMIT 1) AS other
  FROM (SELECT DISTINCT row_id, device_id FROM change_log) k)"""))
def _(led: GivenLedger) -> DataFrame:
    return joins.latest_other_author(led.change_log, led.change_log).select(
        "id", "other_device_id", "other_changed_at")


# ---- counts -------------------------------------------------------------------------
@register("count_transactions", ledger_sql("""
    SELECT space_id, count(*) AS total, (count(*) + 24) // 25 AS page_count FROM scoped
    WHERE approved AND value_date >= '1997-01-01' AND contains(lower(text), 'ring') GROUP BY 1""", SCOPED))
def _(led: GivenLedger) -> DataFrame:
    return listing.transaction_pages(
        led.transactions(balance=False), led.accounts, limit=25, term="ring", approved=True,
        date_from="1997-01-01")


@register("count_summaries", ledger_sql("""
    SELECT a.space_id, count(*) AS total, greatest((count(*) + 9) // 10, 1) AS page_count
    FROM account_summaries s JOIN accounts a ON a.id = s.account_id GROUP BY 1"""))
def _(led: GivenLedger) -> DataFrame:
    return listing.summary_pages(led.account_summaries, led.accounts)


@register("count_members", ledger_sql(
    "SELECT space_id, count(*) AS members FROM space_members GROUP BY 1"))
def _(led: GivenLedger) -> DataFrame:
    return aggregates.count_members(led.space_members)


@register("count_users", ledger_sql("SELECT count(*) AS users FROM users"))
def _(led: GivenLedger) -> DataFrame:
    return aggregates.count_users(led.users)


@register("count_labelled", ledger_sql("""
    SELECT space_id, count(*) AS labelled, count(*) >= 20 AS trainable FROM scoped
    WHERE approved AND category IS NOT NULL AND category <> '' GROUP BY 1""", SCOPED))
def _(led: GivenLedger) -> DataFrame:
    return aggregates.count_labelled(led.transactions(text=False, balance=False), led.accounts)


@register("sole_owner_spaces", ledger_sql("""
    SELECT user_id, space_id FROM space_members WHERE role = 'owner'
    GROUP BY 1, 2 HAVING count(*) = 1"""))
def _(led: GivenLedger) -> DataFrame:
    return aggregates.sole_owner_spaces(led.space_members)


@register("sole_owner_spaces_corrected", ledger_sql("""
    SELECT min(user_id) AS user_id, space_id FROM thin WHERE role = 'owner'
    GROUP BY space_id HAVING count(*) = 1""", """
thin AS (SELECT 's' || s_suppkey AS space_id, 'u' || s_nationkey AS user_id, 'owner' AS role FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 'v' || s_nationkey, 'owner' FROM supplier WHERE s_suppkey % 3 = 0)"""))
def _(led: GivenLedger) -> DataFrame:
    supplier = led.read("supplier")
    space = F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("space_id")
    role = F.lit("owner").alias("role")
    nation = F.col("s_nationkey").cast("string")
    members = supplier.select(space, F.concat(F.lit("u"), nation).alias("user_id"), role).unionByName(
        supplier.where("s_suppkey % 3 = 0").select(space, F.concat(F.lit("v"), nation).alias("user_id"), role))
    return aggregates.sole_owner_spaces(members, corrected=True)


@register("seq_bounds", ledger_sql("""
    SELECT r.space_id, r.device_id, coalesce(min(l.seq), 0) AS min_seq, coalesce(max(l.seq), 0) AS max_seq
    FROM (SELECT space_id, device_id FROM trusted_devices
          UNION SELECT space_id, device_id FROM evicted_devices) r
    LEFT JOIN change_log l ON l.space_id = r.space_id AND l.device_id = r.device_id GROUP BY 1, 2"""))
def _(led: GivenLedger) -> DataFrame:
    pairs = ["space_id", "device_id"]
    requested = led.trusted_devices.select(*pairs).unionByName(led.evicted_devices.select(*pairs))
    return aggregates.seq_bounds(led.change_log, requested)


@register("distinct_devices", ledger_sql("SELECT DISTINCT device_id FROM change_log"))
def _(led: GivenLedger) -> DataFrame:
    return aggregates.distinct_devices(led.change_log)


# ---- listings -----------------------------------------------------------------------
@register("list_transactions", ledger_sql("""
    SELECT * FROM listed WHERE space_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY space_id ORDER BY value_date DESC, text, id) BETWEEN 51 AND 75
    """, SCOPED, LISTED))
def _(led: GivenLedger) -> DataFrame:
    """Third page of 25 of every space."""
    return listing.list_transactions(led.transactions(), led.accounts, page=2, limit=25)


@register("list_transactions_of_space", ledger_sql("""
    SELECT * EXCLUDE (space_id) FROM listed
    WHERE space_id = 's2' AND approved AND contains(lower(text), 'bolt')
    ORDER BY value_date DESC, text, id LIMIT 10 OFFSET 10""", SCOPED, LISTED))
def _(led: GivenLedger) -> DataFrame:
    return listing.list_transactions(
        led.transactions(), led.accounts, space_id="s2", page=1, term="bolt", approved=True)


@register("list_transactions_after", ledger_sql("""
    SELECT * EXCLUDE (space_id) FROM listed WHERE space_id = 's1'
      AND (value_date < '1999-01-01' OR (value_date = '1999-01-01' AND (text > 'm' OR (text = 'm' AND id > 't'))))
    ORDER BY value_date DESC, text, id LIMIT 200""", SCOPED, LISTED))
def _(led: GivenLedger) -> DataFrame:
    return listing.list_after(
        led.transactions(), led.accounts, "s1", ("1999-01-01", "m", "t"), limit=500)


@register("list_account_summaries", ledger_sql("""
    SELECT a.space_id, s.month, s.account_id, a.name AS account_name, s.balance
    FROM account_summaries s JOIN accounts a ON a.id = s.account_id
    QUALIFY row_number() OVER (PARTITION BY a.space_id ORDER BY s.month DESC, a.name, a.id) BETWEEN 21 AND 40"""))
def _(led: GivenLedger) -> DataFrame:
    return listing.list_account_summaries(led.account_summaries, led.accounts, page=1, limit=20)


@register("ordered_accounts", ledger_sql(
    "SELECT id, name, currency, account_type, account_source, color, space_id FROM accounts"))
def _(led: GivenLedger) -> DataFrame:
    return listing.ordered_listing(led.accounts, "accounts")


@register("ordered_members", ledger_sql("SELECT * FROM space_members"))
def _(led: GivenLedger) -> DataFrame:
    return listing.ordered_listing(led.space_members, "space_members")


@register("ordered_categories", ledger_sql("SELECT * FROM categories"))
def _(led: GivenLedger) -> DataFrame:
    return listing.ordered_listing(led.categories, "categories")


@register("ordered_devices", ledger_sql("SELECT * FROM trusted_devices"))
def _(led: GivenLedger) -> DataFrame:
    return listing.ordered_listing(led.trusted_devices, "trusted_devices")


@register("ordered_versions", ledger_sql("SELECT * FROM model_versions"))
def _(led: GivenLedger) -> DataFrame:
    return listing.ordered_listing(led.model_versions, "model_versions")


@register("sample_labelled", ledger_sql("""
    SELECT id, space_id, category FROM scoped WHERE approved AND category IS NOT NULL AND category <> ''
    QUALIFY row_number() OVER (PARTITION BY space_id ORDER BY md5(id || '#11'), id) <= 30""", SCOPED))
def _(led: GivenLedger) -> DataFrame:
    rows = led.transactions(text=False, balance=False)
    return listing.sample_labelled(rows, led.accounts, 30, 11).select("id", "space_id", "category")


# ---- sets ---------------------------------------------------------------------------
@register("known_devices", ledger_sql("""
    SELECT space_id, device_id, cert_pem FROM trusted_devices
    UNION SELECT space_id, device_id, cert_pem FROM evicted_devices"""))
def _(led: GivenLedger) -> DataFrame:
    return sets.known_devices(led.trusted_devices, led.evicted_devices)


@register("missing_versions", ledger_sql("""
    SELECT * FROM model_versions WHERE (space_id, version) NOT IN
      (SELECT (space_id, version) FROM model_versions WHERE version % 3 = 0)"""))
def _(led: GivenLedger) -> DataFrame:
    return sets.missing_versions(led.model_versions, led.model_versions.where("version % 3 = 0"))


# ---- scalar functions ---------------------------------------------------------------
@register("ledger_text_functions", ledger_sql("""
    SELECT id, substr(value_date, 1, 7) AS month, printf('%.2f', amount / 100.0::DOUBLE) AS money,
           lower(trim(split_part(text, '/', 1))) AS merchant, account_id || ':' || value_date AS pair,
           account_id AS head, value_date AS tail FROM transactions"""))
def _(led: GivenLedger) -> DataFrame:
    pair = composite_key(F.col("account_id"), F.col("value_date"))
    return led.transactions(balance=False).select(
        "id", month_of(F.col("value_date")).alias("month"), money_text(F.col("amount")).alias("money"),
        clean_text(F.col("text")).alias("merchant"), pair.alias("pair"),
        key_head(pair).alias("head"), key_tail(pair).alias("tail"))
