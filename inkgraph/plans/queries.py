"""Queries over vaults that are made from the star schema and the documents table, each with the SQL of its rows.

The SQL never parses Markdown: it computes what the vault's construction implies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.functions import text as X
from inkgraph.operators import diff, edit, links, parse, retrieve
from inkgraph.operators import search as ranked
from inkgraph.plans import grammar, tools
from inkgraph.sources.vault import hold

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out anew where its scan has fewer tasks than there are cores; large tables stay as they are."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def text_of(*parts: Column | str) -> Column:
    """Columns (and literal strings, in braces-free text) joined, integers in decimal."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# ---- vaults


#: Keys of the customers that share a file, where a file has many.
BLOCK = 5000


def block_of(key: str) -> Column:
    return F.floor(F.col(key) / BLOCK)


def nation_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): a file for each nation and block of customers, with a section for each of them."""
    c = F.col
    customers = table(spark, sf_dir, "customer")
    part = text_of("\n### ", c("c_name"), "\nSegment ", c("c_mktsegment"), ".\n")
    parts = customers.groupBy(c("c_nationkey").alias("n_nationkey"), block_of("c_custkey").alias("block")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", part.alias("t")))).alias("parts"))
    rows = parts.join(F.broadcast(table(spark, sf_dir, "nation")), "n_nationkey")
    text = text_of("# ", c("n_name"), "\nRegion [[region_", c("n_regionkey"), "]].\n\n## Customers\n", F.array_join(F.transform("parts", lambda p: p["t"]), ""))
    return rows.select(text_of("nations/", F.replace(F.lower("n_name"), F.lit(" "), F.lit("_")), "_", c("block"), ".md").alias("file"), text.alias("text"))


def link_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): regions, nations and customers linked by their keys, with links that don't resolve."""
    c = F.col
    regions = table(spark, sf_dir, "region").select(text_of("regions/region_", c("r_regionkey"), ".md").alias("file"), text_of("# ", c("r_name"), "\n").alias("text"))
    nation = text_of("# ", c("n_name"), "\n\n## Home\nIn [[region_", c("n_regionkey"), "]] and [[region_99]].\n\n## Twice\na\n\n## Twice\nb\n")
    nations = table(spark, sf_dir, "nation").select(text_of("nations/nation_", c("n_nationkey"), ".md").alias("file"), nation.alias("text"))
    n = c("c_nationkey")
    customer = text_of(
        "# ", c("c_name"), "\n\n## Place\nFrom [[nation_", n, "#Home]] or **[[nation_", n, "#Twice|two]]**.\nNot `[[code]]` nor \\[[text]].\n\n- See [[#Notes]]\n\n## Notes\n",
        c("c_mktsegment"), " via [[nations/nation_", n, "]] and [[none/at_all]].\n",
    )
    customers = table(spark, sf_dir, "customer").select(text_of("customers/cust_", c("c_custkey"), ".md").alias("file"), customer.alias("text"))
    return regions.union(nations).union(customers)


def segment_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): a file for each nation and block of customers with a heading for each one's market segment, many
    alike."""
    parts = table(spark, sf_dir, "customer").groupBy("c_nationkey", block_of("c_custkey").alias("block")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: F.concat(F.lit("## "), x["c_mktsegment"], F.lit("\n"))), "")
    return parts.select(text_of("segments/nation_", F.col("c_nationkey"), "_", F.col("block"), ".md").alias("file"), body.alias("text"))


def document_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "documents").select(text_of("docs/doc_", c("doc_id"), ".md").alias("file"), text_of("# Document ", c("doc_id"), "\n\n", c("text"), "\n").alias("text"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A customer vault before and after: by key modulo 7, 0 is removed, 1 has another place, 2 no notes, 3 an extra
    section with a subsection, 4 another name; the others stay."""
    c = F.col
    rows = table(spark, sf_dir, "customer").withColumn("m", c("c_custkey") % 7)
    head = [F.lit("# "), c("c_name"), F.lit("\n\n## Place\nSegment "), c("c_mktsegment")]
    notes = F.lit("\n## Notes\nkept\n")
    before = F.concat(*head, F.lit(".\n"), notes)
    after = F.concat(
        *head, F.when(c("m") == 1, F.lit(" moved.\n")).otherwise(F.lit(".\n")), F.when(c("m") == 2, F.lit("")).otherwise(notes),
        F.when(c("m") == 3, F.lit("\n## Extra\nx\n\n### Sub\ny\n")).otherwise(F.lit("")),
    )
    name = text_of("customers/cust_", c("c_custkey"), ".md")
    moved = F.when(c("m") == 4, text_of("customers/moved_", c("c_custkey"), ".md")).otherwise(name)
    return rows.select(name.alias("file"), before.alias("text")), rows.where("m <> 0").select(moved.alias("file"), after.alias("text"))


def front_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): customers with front matter; that of every fifth key is broken."""
    c = F.col
    value = F.when(c("c_custkey") % 5 == 0, F.lit("[broken")).otherwise(F.lit("[a, b]"))
    text = text_of("---\nkey: ", c("c_custkey"), "\nname: ", c("c_mktsegment"), "\ntags: ", value, "\n---\n# ", c("c_name"), "\nbody\n")
    return table(spark, sf_dir, "customer").select(text_of("front/cust_", c("c_custkey"), ".md").alias("file"), text.alias("text"))


def sections_of(vault: DataFrame) -> DataFrame:
    return parse.sections(parse.parse_documents(vault))


def resolved_of(vault: DataFrame) -> DataFrame:
    """Resolved links; sections and links come from one parse, which is written to the checkpoint folder."""
    parsed = hold(parse.parse_documents(vault).select("file", F.struct("parsed.sections", "parsed.links").alias("parsed")))
    return links.resolve(parse.raw_links(parsed), parse.sections(parsed), parsed.select("file"))


# ---- queries


def vault_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nation_vault(spark, sf_dir).select("file", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))


def sections_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections_of(nation_vault(spark, sf_dir))
    return s.select("file", "ord", "parent_ord", "level", "heading", "heading_path", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"))


def section_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections_of(nation_vault(spark, sf_dir)).select("file", "heading_path", "content_hash")


def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections_of(nation_vault(spark, sf_dir)).select("file", "heading_path", "line_start", "line_end")


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.outline(sections_of(link_vault(spark, sf_dir)))


def get_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    vault = link_vault(spark, sf_dir)
    asked = table(spark, sf_dir, "customer").select(text_of("customers/cust_", F.col("c_custkey"), ".md").alias("file"), text_of(F.col("c_name"), " > Notes").alias("heading_path"))
    return retrieve.get_sections(vault, sections_of(vault), asked).select("file", "heading_path", "content", "content_hash")


SEARCHES = {
    "search_exact_path": "Nation_7 > Customers",
    "search_heading": "customers",
    "search_reordered": "7 nation",
    "search_all_prefix": "nat cust",
    "search_partial": "customers zebra",
}


def search(query: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ranked.search(sections_of(nation_vault(spark, sf_dir)), query).select("score", "file", "heading_path")

    return run


def search_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = spark.createDataFrame(list(enumerate(SEARCHES.values())), "query_id int, query string")
    return ranked.search_many(sections_of(nation_vault(spark, sf_dir)), queries)


def nearest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sections_of(nation_vault(spark, sf_dir))
    needles = s.where("ord = 0").select(F.col("file").alias("needle_id"), F.col("file").alias("key"), text_of(F.col("heading"), " > Custoners").alias("needle"))
    return retrieve.nearest(s.select(F.col("file").alias("key"), F.col("heading_path").alias("candidate")), needles)


def duplicate_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections_of(segment_vault(spark, sf_dir)).select("file", "ord", "heading_path")


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections_of(document_vault(spark, sf_dir)).select("file", "heading_path", F.col("end").alias("end_byte"), "content_hash")


def raw_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.raw_links(parse.parse_documents(link_vault(spark, sf_dir))).select("file", "link_ord", "target", "label")


def links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.backlinks(resolved_of(link_vault(spark, sf_dir))).select("target_file", "target_heading_path", "from_file", "from_heading_path", "raw_target")


def backlinks_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = links.backlinks(resolved_of(link_vault(spark, sf_dir)))
    return edges.groupBy("target_file").agg(F.count("*").alias("n"))


def backlinks_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = links.backlinks(resolved_of(link_vault(spark, sf_dir)))
    return edges.where("target_heading_path IS NOT NULL").groupBy("target_file", "target_heading_path").agg(F.count("*").alias("n"))


def _unresolved(like: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = resolved_of(link_vault(spark, sf_dir))
        return links.link_diagnostics(rows.where(F.col("reason").contains(like)))

    return run


def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_files(*snapshots(spark, sf_dir))


def _diff(change: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        old, new = snapshots(spark, sf_dir)
        rows = diff.diff_sections(sections_of(old), sections_of(new), old, new)
        return rows.where(F.col("change") == change).select("file", "heading_path")

    return run


def edit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of every customer's place: by key modulo 5, accepted, stale, escaping, of no section, or merging."""
    docs, _ = snapshots(spark, sf_dir)
    c = F.col
    rows = table(spark, sf_dir, "customer").withColumn("m", c("c_custkey") % 5)
    good = F.sha2(F.concat(F.lit("## Place\nSegment "), c("c_mktsegment"), F.lit(".")), 256)
    body = F.when(c("m") == 2, "## Bad\nx").when(c("m") == 4, "```\nopen").otherwise(F.concat(F.lit("New "), c("c_name"), F.lit(".\n\n")))
    edits = rows.select(
        text_of("customers/cust_", c("c_custkey"), ".md").alias("file"), F.concat(c("c_name"), F.when(c("m") == 3, " > Nowhere").otherwise(" > Place")).alias("heading_path"),
        body.alias("body"), F.when(c("m") == 1, "stale").otherwise(good).alias("expected_hash"),
    )
    done = edit.edit_many(docs, edits)
    return done.select("file", "status", "current_hash", F.sha2("edited", 256).alias("edited_sha256"))


def token_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = X.tokens(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", own.alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


def levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of every part name to its brand and type."""
    c = F.col
    near = X.nearest_distance
    return table(spark, sf_dir, "part").select("p_partkey", near(c("p_name"), c("p_type")).alias("to_type"), near(c("p_name"), c("p_brand")).alias("to_brand"))


def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("./lore//"), F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, F.lit("\\..\\x")).otherwise(F.lit("\\.\\x.md")))
    return table(spark, sf_dir, "customer").select("c_custkey", X.normalize_path(path).alias("path"), X.file_stem(path).alias("stem"))


def char_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character references of the pages, and those made from their ids: decimal, hexadecimal and names with digits."""
    pages = table(spark, sf_dir, "pages")
    own = F.regexp_extract_all("html", F.lit("(&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)"))
    code = F.col("page_id") % 2000 + 33
    made = F.array(text_of("&#", code, ";"), F.concat(F.lit("&#x"), F.lower(F.hex(code)), F.lit(";")), F.concat(F.lit("&#X"), F.hex(code), F.lit(";")), F.lit("&frac12;"), F.lit("&sup2;"), F.lit("&#0;"), F.lit("&#12345678;"), F.lit("&there4;"))
    refs = pages.select(F.explode(F.concat(F.coalesce(own, F.array().cast("array<string>")), made)).alias("ref"))
    counted = refs.groupBy("ref").agg(F.count("*").alias("n"))
    return counted.select("ref", "n", parse.character_references(F.col("ref")).alias("decoded"))


def frontmatter_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.metadata(parse.parse_documents(front_vault(spark, sf_dir)))
    get = lambda path, kind: F.try_variant_get("metadata", path, kind)
    return rows.select("file", get("$.key", "long").alias("key"), get("$.name", "string").alias("name"), get("$.tags[1]", "string").alias("tag"))


def diagnostics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose front matter is invalid; its message names the parser's position and isn't compared."""
    rows = parse.document_diagnostics(parse.parse_documents(front_vault(spark, sf_dir)))
    return rows.select("file", F.substring("message", 1, 24).alias("message"))


def syntax_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse.syntax_nodes(link_vault(spark, sf_dir)).where("kind IN ('heading', 'list', 'item', 'wikilink', 'code', 'strong', 'escaped')")
    return nodes.groupBy("layer", "kind").agg(F.count("*").alias("n"))


def region_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = links.backlinks(resolved_of(link_vault(spark, sf_dir)))
    return edges.where(F.col("target_file").startswith("regions/")).groupBy("target_file").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    plain = [
        vault_files, sections_v1, section_hash, line_ranges, outline, get_section, search_order, nearest_paths, duplicate_headings, document_sections, raw_wikilinks,
        links_resolved, backlinks_file, backlinks_heading, diff_files, edit_batch, token_normalize, levenshtein, path_normalize, char_refs, frontmatter_meta,
        diagnostics_all, syntax_kinds, region_backlinks,
    ]
    out: dict[str, Query] = {f.__name__: f for f in plain}
    out |= {name: search(query) for name, query in SEARCHES.items()}
    out |= grammar.QUERIES | tools.QUERIES
    out |= {"links_unresolved": _unresolved("no file matches"), "links_ambiguous": _unresolved("is ambiguous")}
    return out | {f"diff_{change}": _diff(change) for change in ("added", "removed", "modified")}


# ---- SQL

_FILE = "'nations/' || replace(lower(n_name), ' ', '_') || '_' || block || '.md'"

_V1 = f"""
WITH c AS (
  SELECT c_nationkey, c_custkey, c_custkey // {BLOCK} AS block, c_name, chr(10) || '### ' || c_name || chr(10) || 'Segment ' || c_mktsegment || '.' || chr(10) AS t,
    row_number() OVER (PARTITION BY c_nationkey, c_custkey // {BLOCK} ORDER BY c_custkey) - 1 AS i FROM customer
), b AS (
  SELECT c_nationkey, block, string_agg(t, '' ORDER BY c_custkey) AS body, count(*) AS k FROM c GROUP BY c_nationkey, block
), n AS (
  SELECT n_nationkey, block, n_name, body, k, {_FILE} AS file, '# ' || n_name || chr(10) || 'Region [[region_' || n_regionkey || ']].' || chr(10) || chr(10) AS top
  FROM nation JOIN b ON c_nationkey = n_nationkey
), h AS (
  SELECT n.*, top || '## Customers' || chr(10) AS head FROM n
), p AS (
  SELECT c_nationkey, block, c_name, i, t, coalesce(sum(strlen(t)) OVER (PARTITION BY c_nationkey, block ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c
), s AS (
  SELECT file, 0 AS ord, NULL AS parent_ord, 1 AS level, n_name AS heading, n_name AS heading_path, 0 AS a, strlen(head || body) - 1 AS b,
    1 AS line_start, CASE WHEN k = 0 THEN 4 ELSE 4 + 3 * k END AS line_end, head || body AS content FROM h
  UNION ALL
  SELECT file, 1, 0, 2, 'Customers', n_name || ' > Customers', strlen(top), strlen(head || body) - 1, 4, CASE WHEN k = 0 THEN 4 ELSE 4 + 3 * k END, head || body FROM h
  UNION ALL
  SELECT file, 2 + i, 1, 3, c_name, n_name || ' > Customers > ' || c_name, strlen(head) + before + 1, strlen(head) + before + strlen(t) - 1, 6 + 3 * i, 7 + 3 * i, head || body
  FROM h JOIN p ON c_nationkey = n_nationkey AND p.block = h.block
)
"""

_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"


def _search_sql(query: str) -> str:
    """Scores, by the five tiers, of every section of the nation vault."""
    near = "len(list_filter(q, lambda x: len(list_filter({0}, lambda y: starts_with(x, y) OR starts_with(y, x))) > 0))"
    return f"""{_V1}, t AS (
  SELECT file, heading_path, {_TOKENS.format("'" + query + "'")} AS q, {_TOKENS.format('heading')} AS h, {_TOKENS.format('heading_path')} AS p FROM s
), m AS (
  SELECT *, greatest({near.format('h')}, {near.format('p')}) AS best, len(list_filter(q, lambda x: list_contains(p, x))) AS exact FROM t
), r AS (
  SELECT file, heading_path, CAST(CASE WHEN q = p THEN 40000 WHEN q = h THEN 30000 WHEN list_sort(q) = list_sort(h) THEN 29000 WHEN best = 0 THEN NULL
    WHEN best = len(q) THEN 20000 + 100 * exact ELSE 10000 + 100 * best + exact END AS INTEGER) AS score FROM m
)"""


def _order_sql() -> str:
    parts = []
    for i, query in enumerate(SEARCHES.values()):
        depth = "len(string_split(heading_path, ' > '))"
        parts.append(f"SELECT * FROM ({_search_sql(query)} SELECT {i} AS query_id, CAST(row_number() OVER (ORDER BY score DESC, {depth}, file, heading_path) AS INTEGER) AS rank, score, file, heading_path FROM r WHERE score IS NOT NULL)")
    return " UNION ALL ".join(parts)


_CUST = "'customers/cust_' || c_custkey || '.md'"
_NATION = "'nations/nation_' || n_nationkey || '.md'"

_EDGES = f"""
WITH e AS (
  SELECT 'regions/region_' || n_regionkey || '.md' AS target_file, NULL AS target_heading_path, {_NATION} AS from_file, n_name || ' > Home' AS from_heading_path, 'region_' || n_regionkey AS raw_target
  FROM nation
  UNION ALL SELECT {_NATION}, n_name || ' > Home', {_CUST}, c_name || ' > Place', 'nation_' || n_nationkey || '#Home' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT {_CUST}, c_name || ' > Notes', {_CUST}, c_name || ' > Place', '#Notes' FROM customer
  UNION ALL SELECT {_NATION}, NULL, {_CUST}, c_name || ' > Notes', 'nations/nation_' || n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey
)
"""

_SAID = "'wikilink ''[[' || {0} || ']]'' in section ''' || {1} || ''' of ''' || {2} || ''' does not resolve: ' || {3}"


#: Columns that are 32-bit integers in the queries and wider in the SQL.
_INTEGERS = {
    "sections_v1": ["ord", "start_byte", "end_byte"], "line_ranges": ["line_start", "line_end"], "outline": ["ord", "line_start", "line_end"], "duplicate_headings": ["ord"],
    "document_sections": ["end_byte"], "raw_wikilinks": ["link_ord"], "levenshtein": ["to_type", "to_brand"],
}


def oracle_sql() -> dict[str, str]:
    m = "c_custkey % 7"
    out = {
        "vault_files": f"{_V1} SELECT file, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM s WHERE ord = 0",
        "sections_v1": f"{_V1} SELECT file, ord, parent_ord, level, heading, heading_path, a AS start_byte, b AS end_byte FROM s",
        "section_hash": f"{_V1} SELECT file, heading_path, sha256(substr(content, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT))) AS content_hash FROM s",
        "line_ranges": f"{_V1} SELECT file, heading_path, line_start, line_end FROM s",
        "outline": f"""
          SELECT 'regions/region_' || r_regionkey || '.md' AS file, 0 AS ord, NULL AS parent_ord, r_name AS heading, 1 AS level, r_name AS heading_path, 1 AS line_start, 1 AS line_end FROM region
          UNION ALL SELECT {_NATION}, o, CASE WHEN o > 0 THEN 0 END, CASE o WHEN 0 THEN n_name WHEN 1 THEN 'Home' ELSE 'Twice' END, CASE o WHEN 0 THEN 1 ELSE 2 END,
            n_name || CASE o WHEN 0 THEN '' WHEN 1 THEN ' > Home' WHEN 2 THEN ' > Twice' ELSE ' > Twice[2]' END, CASE o WHEN 0 THEN 1 ELSE 3 * o END, CASE o WHEN 0 THEN 10 ELSE 3 * o + 1 END FROM nation, range(4) r(o)
          UNION ALL SELECT {_CUST}, o, CASE WHEN o > 0 THEN 0 END, CASE o WHEN 0 THEN c_name WHEN 1 THEN 'Place' ELSE 'Notes' END, CASE o WHEN 0 THEN 1 ELSE 2 END,
            c_name || CASE o WHEN 0 THEN '' WHEN 1 THEN ' > Place' ELSE ' > Notes' END, CASE o WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 9 END, CASE o WHEN 1 THEN 7 ELSE 10 END FROM customer, range(3) r(o)""",
        "get_section": f"""
          WITH t AS (SELECT {_CUST} AS file, c_name || ' > Notes' AS heading_path,
            '## Notes' || chr(10) || c_mktsegment || ' via [[nations/nation_' || c_nationkey || ']] and [[none/at_all]].' AS content FROM customer)
          SELECT file, heading_path, content, sha256(content) AS content_hash FROM t""",
        "search_order": _order_sql(),
        "nearest_paths": f"""{_V1}, d AS (
          SELECT n.file AS needle_id, heading_path AS candidate,
            row_number() OVER (PARTITION BY n.file ORDER BY levenshtein(lower(n_name || ' > Custoners'), lower(heading_path)), heading_path) AS rank
          FROM n JOIN s ON s.file = n.file)
          SELECT needle_id, CAST(rank AS INTEGER) AS rank, candidate FROM d WHERE rank <= 3""",
        "duplicate_headings": f"""
          WITH d AS (SELECT c_nationkey, c_custkey // {BLOCK} AS block, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_custkey // {BLOCK} ORDER BY c_custkey) - 1 AS ord,
            row_number() OVER (PARTITION BY c_nationkey, c_custkey // {BLOCK}, c_mktsegment ORDER BY c_custkey) AS k FROM customer)
          SELECT 'segments/nation_' || c_nationkey || '_' || block || '.md' AS file, ord, c_mktsegment || CASE WHEN k = 1 THEN '' ELSE '[' || k || ']' END AS heading_path FROM d""",
        "document_sections": """
          WITH d AS (SELECT doc_id, '# Document ' || doc_id || chr(10) || chr(10) || text AS content FROM documents)
          SELECT 'docs/doc_' || doc_id || '.md' AS file, 'Document ' || doc_id AS heading_path, strlen(content) AS end_byte, sha256(content) AS content_hash FROM d""",
        "raw_wikilinks": f"""
          SELECT {_NATION} AS file, o AS link_ord, CASE o WHEN 0 THEN 'region_' || n_regionkey ELSE 'region_99' END AS target, NULL AS label FROM nation, range(2) r(o)
          UNION ALL SELECT {_CUST}, o, CASE o WHEN 0 THEN 'nation_' || c_nationkey || '#Home' WHEN 1 THEN 'nation_' || c_nationkey || '#Twice' WHEN 2 THEN '#Notes'
            WHEN 3 THEN 'nations/nation_' || c_nationkey ELSE 'none/at_all' END, CASE o WHEN 1 THEN 'two' END FROM customer, range(5) r(o)""",
        "links_resolved": f"{_EDGES} SELECT * FROM e",
        "backlinks_file": f"{_EDGES} SELECT target_file, count(*) AS n FROM e GROUP BY target_file",
        "backlinks_heading": f"{_EDGES} SELECT target_file, target_heading_path, count(*) AS n FROM e WHERE target_heading_path IS NOT NULL GROUP BY target_file, target_heading_path",
        "region_backlinks": f"{_EDGES} SELECT target_file, count(*) AS n FROM e WHERE starts_with(target_file, 'regions/') GROUP BY target_file",
        "links_unresolved": "SELECT " + _NATION + " AS file, " + _SAID.format("'region_99'", "n_name || ' > Home'", _NATION, "'no file matches ''region_99'''") + " AS message FROM nation UNION ALL SELECT "
        + _CUST + ", " + _SAID.format("'none/at_all'", "c_name || ' > Notes'", _CUST, "'no file matches path ''none/at_all'''") + " FROM customer",
        "links_ambiguous": "SELECT " + _CUST + " AS file, " + _SAID.format("'nation_' || c_nationkey || '#Twice'", "c_name || ' > Place'", _CUST, "'heading ''Twice'' is ambiguous: ' || n_name || ' > Twice, ' || n_name || ' > Twice[2]'")
        + " AS message FROM customer JOIN nation ON c_nationkey = n_nationkey",
        "diff_files": f"""
          SELECT 'removed' AS change, {_CUST} AS file FROM customer WHERE {m} IN (0, 4)
          UNION ALL SELECT 'added', 'customers/moved_' || c_custkey || '.md' FROM customer WHERE {m} = 4""",
        "diff_added": f"SELECT {_CUST} AS file, c_name || ' > Extra' AS heading_path FROM customer WHERE {m} = 3",
        "diff_removed": f"SELECT {_CUST} AS file, c_name || ' > Notes' AS heading_path FROM customer WHERE {m} = 2",
        "diff_modified": f"SELECT {_CUST} AS file, c_name || ' > Place' AS heading_path FROM customer WHERE {m} = 1",
        "edit_batch": f"""
          SELECT {_CUST} AS file, CASE c_custkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'conflict' WHEN 2 THEN 'escape' WHEN 3 THEN 'not_found' ELSE 'restructure' END AS status,
            CASE WHEN c_custkey % 5 = 1 THEN sha256('## Place' || chr(10) || 'Segment ' || c_mktsegment || '.') END AS current_hash,
            CASE WHEN c_custkey % 5 = 0 THEN sha256('# ' || c_name || chr(10) || chr(10) || '## Place' || chr(10) || 'New ' || c_name || '.' || chr(10) || chr(10) || '## Notes' || chr(10) || 'kept' || chr(10)) END AS edited_sha256
          FROM customer""",
        "token_normalize": r"""
          WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents)
          SELECT doc_id, CAST(len(t) AS BIGINT) AS n, sha256(lower(array_to_string(t, ' '))) AS tokens_sha256 FROM t""",
        "levenshtein": "SELECT p_partkey, levenshtein(lower(p_name), lower(p_type)) AS to_type, levenshtein(lower(p_name), lower(p_brand)) AS to_brand FROM part",
        "path_normalize": r"""
          SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'lore/' || c_name || '/x.md' END AS path, c_name || CASE WHEN c_custkey % 3 = 0 THEN '\..\x' ELSE '\.\x' END AS stem FROM customer""",
        "char_refs": """
          WITH r AS (
            SELECT unnest(regexp_extract_all(html, '&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);')) AS ref, NULL AS code FROM pages
            UNION ALL SELECT '&#' || (page_id % 2000 + 33) || ';', page_id % 2000 + 33 FROM pages
            UNION ALL SELECT '&#x' || lower(hex(page_id % 2000 + 33)) || ';', page_id % 2000 + 33 FROM pages
            UNION ALL SELECT '&#X' || hex(page_id % 2000 + 33) || ';', page_id % 2000 + 33 FROM pages
            UNION ALL SELECT unnest(['&frac12;', '&sup2;', '&#0;', '&#12345678;', '&there4;']), NULL FROM pages)
          SELECT ref, count(*) AS n, CASE WHEN max(code) IS NOT NULL THEN chr(CAST(max(code) AS INTEGER)) ELSE CASE ref WHEN '&frac12;' THEN chr(189) WHEN '&sup2;' THEN chr(178) WHEN '&#0;' THEN chr(65533) WHEN '&there4;' THEN chr(8756) WHEN '&amp;' THEN '&' WHEN '&copy;' THEN chr(169) WHEN '&middot;' THEN chr(183) WHEN '&quot;' THEN '"' WHEN '&nbsp;' THEN chr(160)
            WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&eacute;' THEN chr(233) WHEN '&mdash;' THEN chr(8212) WHEN '&hellip;' THEN chr(8230) END END AS decoded FROM r GROUP BY ref""",
        "frontmatter_meta": """
          SELECT 'front/cust_' || c_custkey || '.md' AS file, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS key, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS name,
            CASE WHEN c_custkey % 5 <> 0 THEN 'b' END AS tag FROM customer""",
        "diagnostics_all": "SELECT 'front/cust_' || c_custkey || '.md' AS file, 'invalid YAML frontmatter' AS message FROM customer WHERE c_custkey % 5 = 0",
        "syntax_kinds": """
          WITH x AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM region) AS r)
          SELECT 'block' AS layer, 'heading' AS kind, 3 * c + 4 * n + r AS n FROM x
          UNION ALL SELECT 'block', 'list', c FROM x UNION ALL SELECT 'block', 'item', c FROM x UNION ALL SELECT 'inline', 'wikilink', 5 * c + 2 * n FROM x
          UNION ALL SELECT 'inline', 'code', c FROM x UNION ALL SELECT 'inline', 'strong', c FROM x UNION ALL SELECT 'inline', 'escaped', c FROM x""",
    }
    for name, columns in _INTEGERS.items():
        casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in columns)
        out[name] = f"SELECT * REPLACE ({casts}) FROM ({out[name]})"
    out |= grammar.oracle_sql() | tools.oracle_sql()
    return out | {name: f"{_search_sql(query)} SELECT score, file, heading_path FROM r WHERE score IS NOT NULL" for name, query in SEARCHES.items()}
