"""Operators on the node tree: point lookups, children, ancestors, subtrees, tables of contents, roll-ups.

The tree has at most LEVELS levels, so ancestors and subtrees of whole trees are unrolled self-joins on ids; no iteration
and no driver loop depends on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.sources.relations import dealt

LEVELS = 7
LEVEL_OF = {"part": 0, "section": 1, "subsection": 2, "alt_subsection": 2, "article": 3, "article_suffix": 3, "article_0a": 3, "sub_article": 3, "clause": 4, "subclause": 5, "subsubclause": 6}


def joined(items: Column, separator: str) -> Column:
    """The texts of an array of (order, text) structs, in order."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), separator)


def natural_key(id_: Column) -> Column:
    """Sort key of dotted ids by their numbers."""
    return F.transform(F.regexp_extract_all(id_, F.lit("([0-9]+)"), 1), lambda x: x.cast("long"))


def level(type_: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LEVEL_OF.items() for x in kv])[type_], F.lit(99))


def node_by_id(nodes: DataFrame, id_: str) -> DataFrame:
    """A part, section or subsection; articles and clauses are not looked up. Where nodes are stored by part, the id's part
    prunes the files; an id that doesn't begin with a number is no node."""
    part = id_.split(".")[0]
    found = nodes.filter((F.col("id") == id_) & F.col("type").isin("part", "section", "subsection"))
    return found.filter(F.col("part") == int(part)) if part.isdecimal() else found.limit(0)


def children(nodes: DataFrame, parent_id: str) -> DataFrame:
    return nodes.filter(F.col("parent_id") == parent_id).orderBy("seq", "id")


def nodes_by_type(nodes: DataFrame, type_: str) -> DataFrame:
    return nodes.filter(F.col("type") == type_).orderBy("seq", "id")


def prefix_parent(id_: Column) -> Column:
    """The id without its last dotted component; null at the root."""
    parts = F.split(id_, r"\.")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "."))


def breadcrumbs(nodes: DataFrame) -> DataFrame:
    """id, path (root / ... / node), depth for every node: an id holds the ids of its ancestors, so no join is needed."""
    depth = F.length("id") - F.length(F.replace("id", F.lit("."))) + 1
    ids = F.expr("transform(sequence(1, depth), n -> substring_index(id, '.', n))")
    return nodes.select("id", depth.cast("int").alias("depth")).select("id", F.array_join(ids, "/").alias("path"), "depth")


def breadcrumbs_by_parent(nodes: DataFrame) -> DataFrame:
    """The same for ids that don't hold their ancestors, by the parents' ids: LEVELS - 1 joins."""
    up = nodes.select(F.col("id").alias("_id"), F.col("parent_id").alias("_up"))
    out = nodes.select("id", F.col("parent_id").alias("_next"), F.array("id").alias("_path"))
    for _ in range(LEVELS - 1):
        out = out.join(up, F.col("_next") == F.col("_id"), "left").select("id", F.col("_up").alias("_next"), F.when(F.col("_id").isNotNull(), F.concat(F.array("_id"), "_path")).otherwise(F.col("_path")).alias("_path"))
    return out.select("id", F.array_join("_path", "/").alias("path"), F.size("_path").alias("depth"))


def subtree(nodes: DataFrame, root: str) -> DataFrame:
    """id, depth of the nodes below and at root, by unrolled joins from the top."""
    level_ = nodes.filter(F.col("id") == root).select("id", F.lit(0).alias("depth"))
    out = level_
    for d in range(1, LEVELS):
        level_ = nodes.join(level_.select(F.col("id").alias("_p")), F.col("parent_id") == F.col("_p")).select("id", F.lit(d).alias("depth"))
        out = out.unionByName(level_)
    return out


def subtree_by_prefix(nodes: DataFrame, root: str) -> DataFrame:
    """The same by the ids alone: one scan with a filter that reaches the files."""
    return nodes.filter((F.col("id") == root) | F.col("id").startswith(f"{root}."))


def sequence_numbers(nodes: DataFrame, n: int | None = None) -> DataFrame:
    """Each node's number under its parent; with n, nodes are dealt in n pieces by their parents and sorted there."""
    rows = nodes.select("id", "parent_id", "seq", F.coalesce("parent_id", F.lit("__root__")).alias("_p"))
    w = Window.partitionBy("_p").orderBy("seq", "id")
    return dealt(rows, n, "_p").select("id", "parent_id", F.row_number().over(w).alias("seq"))


def children_lists(nodes: DataFrame) -> DataFrame:
    kids = nodes.filter("parent_id IS NOT NULL").groupBy("parent_id").agg(joined(F.collect_list(F.struct("seq", F.col("id").alias("text"))), ",").alias("children"), F.count("*").alias("n_children"))
    return kids.withColumnRenamed("parent_id", "id")


def toc(nodes: DataFrame) -> DataFrame:
    """One row for each section: its title and its subsections as id:title, in order."""
    sub = nodes.filter("type = 'subsection'").groupBy("parent_id").agg(joined(F.collect_list(F.struct("seq", F.concat_ws(":", "id", "title").alias("text"))), "|").alias("children"))
    return nodes.filter("type = 'section'").join(sub.withColumnRenamed("parent_id", "_p"), F.col("id") == F.col("_p"), "left").select("part", "id", "title", F.coalesce("children", F.lit("")).alias("children"))


def part_roll_up(nodes: DataFrame, ordered: bool = False) -> DataFrame:
    """part, k, block: the blocks of all parts; k is their natural order in a part.

    A section or subsection is its marker, a blank line and its content, if it has any; a part's text is its blocks in order
    with blank lines between. It is never gathered in one row: with `ordered`, rows are sorted by part and k over range
    partitions, to be written as text.
    """
    rows = nodes.filter("type IN ('section', 'subsection')")
    marker = F.concat(F.lit("["), F.upper("type"), F.lit(":"), "id", F.lit(":"), F.coalesce("title", F.lit("")), F.lit("]"))
    block = F.concat_ws("\n\n", marker, F.when((F.col("content") != "") & (F.col("type") == "subsection"), F.col("content")))
    rows = rows.select("part", natural_key(F.col("id")).alias("k"), block.alias("block"))
    return rows.repartitionByRange("part", "k").sortWithinPartitions("part", "k") if ordered else rows


def clause_roll_up(nodes: DataFrame) -> DataFrame:
    """Content of each article from its clauses: (n) text, one a line."""
    rows = nodes.filter("type = 'clause' AND coalesce(content, '') <> ''")
    text = F.concat(F.lit("("), F.col("seq").cast("string"), F.lit(") "), "content")
    return rows.groupBy(F.col("parent_id").alias("id")).agg(joined(F.collect_list(F.struct("seq", text.alias("text"))), "\n").alias("content"))


def flat_content(nodes: DataFrame) -> DataFrame:
    """Content of each subsection from its articles: heading, blank line, text, blank line, in order."""
    text = F.concat(F.lit("#### "), "id", F.lit(". "), F.coalesce("title", F.lit("")), F.lit("\n"), F.when(F.col("content") != "", F.concat(F.lit("\n"), "content")).otherwise(F.lit("")))
    rows = nodes.filter("type = 'article'").groupBy(F.col("parent_id").alias("id")).agg(joined(F.collect_list(F.struct("seq", text.alias("text"))), "\n\n").alias("content"))
    return rows.withColumn("content", F.regexp_replace("content", r"^\s+|\s+$", ""))


def section_view(nodes: DataFrame, tables: DataFrame, n: int | None = None) -> DataFrame:
    """Everything that a section's page shows: title, number of children, of tables, and the way to it.

    With n, nodes are dealt in n pieces by their parents; they are counted there, and sections meet their counts there.
    """
    kids = dealt(nodes.select("parent_id", "id"), n, "parent_id").groupBy("parent_id").agg(F.count("*").alias("n_children"), F.min("id").alias("first_child"))
    own = tables.groupBy("parent_id").agg(F.count("*").alias("n_tables"))
    s = nodes.filter("type IN ('section', 'subsection')").select("id", "type", "title")
    s = s.join(kids.withColumnRenamed("parent_id", "_k"), F.col("id") == F.col("_k"), "left").join(own.withColumnRenamed("parent_id", "_t"), F.col("id") == F.col("_t"), "left")
    return s.select("id", "type", "title", F.coalesce("n_children", F.lit(0)).alias("n_children"), "first_child", F.coalesce("n_tables", F.lit(0)).alias("n_tables"), F.regexp_replace("id", r"\.", "/").alias("breadcrumb"))


def page_roll_up(nodes: DataFrame) -> DataFrame:
    """A section's own children's text, else its grandchildren's."""
    kid = nodes.filter("type = 'subsection'").select("id", "parent_id", "seq", "content")
    grand = nodes.filter("type = 'article'").groupBy(F.col("parent_id").alias("_g")).agg(joined(F.collect_list(F.struct("seq", F.col("title").alias("text"))), ", ").alias("titles"))
    text = F.coalesce(F.when(F.col("content") != "", F.col("content")), "titles", F.lit(""))
    return kid.join(grand, F.col("id") == F.col("_g"), "left").groupBy(F.col("parent_id").alias("id")).agg(joined(F.collect_list(F.struct("seq", text.alias("text"))), "\n").alias("content"))


def next_sibling(nodes: DataFrame) -> DataFrame:
    w = Window.partitionBy("parent_id").orderBy("seq")
    return nodes.filter("type = 'subsection'").select("id", F.lead("id").over(w).alias("next_id"))


def printed(nodes: DataFrame) -> DataFrame:
    """Each node's line of an indented print-out of the tree: id, type, title or else the start of its content."""
    start = F.when(F.col("content") != "", F.concat(F.substring("content", 1, 30), F.lit("...")))
    label = F.coalesce(F.when(F.col("title") != "", F.col("title")), start, F.lit(""))
    return nodes.select("id", F.concat(F.repeat(F.lit("  "), F.size(F.split("id", r"\.")) - 1), "id", F.lit(" ["), "type", F.lit("] "), label).alias("line"))


def open_ancestors(rows: DataFrame) -> DataFrame:
    """doc, line, type, parent: the nearest line before that is open at a higher level, when the id gives no parent."""
    rank = level(F.col("type"))
    w = Window.partitionBy("doc").orderBy("page", "line", "text").rowsBetween(Window.unboundedPreceding, -1)
    seen = [F.last(F.when(rank == k, F.struct("page", "line", "text")), ignorenulls=True).over(w) for k in range(4)]
    cols = rows.select("doc", "line", "type", "text", *[c.alias(f"_{k}") for k, c in enumerate(seen)])
    above = [F.when(F.lit(k) < level(F.col("type")), F.col(f"_{k}")) for k in range(4)]
    return cols.select("doc", "line", "type", F.array_max(F.array_compact(F.array(*above)))["text"].alias("parent"))


def flattened(parts: DataFrame) -> DataFrame:
    """Nested parts (id, title, sections[id, title, subsections[id, title]]) as rows with a seq in each parent."""
    p = parts.select("id", "title", "sections", F.posexplode("sections").alias("i", "s"))
    sections = p.select(F.col("s.id").alias("id"), F.lit("section").alias("type"), F.col("id").alias("parent_id"), F.col("s.title").alias("title"), (F.col("i") + 1).alias("seq"))
    q = p.select(F.col("s.id").alias("parent_id"), F.posexplode("s.subsections").alias("j", "u"))
    subs = q.select(F.col("u.id").alias("id"), F.lit("subsection").alias("type"), "parent_id", F.col("u.title").alias("title"), (F.col("j") + 1).alias("seq"))
    return sections.unionByName(subs)


def nested(nodes: DataFrame) -> DataFrame:
    """The reverse: one row for each part with its sections and subsections in order."""
    subs = nodes.filter("type = 'subsection'").groupBy(F.col("parent_id").alias("_p")).agg(F.array_sort(F.collect_list(F.struct("seq", "id", "title"))).alias("subsections"))
    sections = nodes.filter("type = 'section'").join(subs, F.col("id") == F.col("_p"), "left")
    item = F.struct("seq", "id", "title", F.coalesce("subsections", F.array().cast("array<struct<seq:bigint,id:string,title:string>>")).alias("subsections"))
    inner = sections.groupBy(F.col("parent_id").alias("_q")).agg(F.array_sort(F.collect_list(item)).alias("sections"))
    return nodes.filter("type = 'part'").join(inner, F.col("id") == F.col("_q")).select("id", "title", "sections")


#: Types whose parent is read off the id; the others hang on the nearest open node of a higher level.
BY_ID = ("alt_subsection", "article_suffix", "article_0a", "sub_article")


def added(script: DataFrame) -> DataFrame:
    """Doc, id, type, parent_id, seq, title, content, refs of the nodes that a script (doc, ord, type, id, title, content) adds.

    Each adding takes the next number under its parent, also one that repeats an id; of the same id the last adding stays.
    refs are the targets that the content refers to, in order, each once.
    """
    rank = level(F.col("type"))
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = script.select("*", *[F.last(F.when(rank == k, F.struct("ord", "id")), ignorenulls=True).over(w).alias(f"_{k}") for k in range(LEVELS - 1)])
    above = F.array_max(F.array_compact(F.array(*[F.when(F.lit(k) < rank, F.col(f"_{k}")) for k in range(LEVELS - 1)])))["id"]
    rows = rows.withColumn("parent_id", F.when(F.col("type").isin(*BY_ID), prefix_parent(F.col("id"))).otherwise(above))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("doc", "parent_id").orderBy("ord")))
    last = rows.withColumn("_back", F.row_number().over(Window.partitionBy("doc", "id").orderBy(F.desc("ord")))).filter("_back = 1")
    refs = F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"(?:Table|Articles?|Subsection|Section)\s+(\d+(?:\.\d+)+[A-Z]?)"), 1))
    return last.select("doc", "id", "type", "parent_id", "seq", "title", "content", refs.alias("refs"))
