"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Pass one reads every text once and writes a narrow table: for each match of the base
patterns and of bare token-like strings its length, the length of the text before it, and
the SHA-256 of its value (never the value). Positions are running sums of those lengths.
Pass two aggregates the hashes: in how many repositories and by how many distinct owners a
value occurs. A value of many owners, or of several owners and many repositories, is a
copied example; a value of one owner that looks random is taken for a live credential.
Base spans always stay, with their class; a bare string becomes a span of kind `owned`
only if it is live by those counts and no base span overlaps it.

Defined results: a null or empty text has no spans; null repositories or owners count as one
unnamed repository or owner; repeated rows are scanned each on its own (their values
count once per owner and repository); an empty table gives an empty table; extra columns are
not read, whatever their names. A very long text costs time in proportion to its matches
(and their sorting): no list grows match by match, and no span is compared with all others.
Counts are pre-aggregated by (value, owner, repository), so a value in a third of all
rows is a few partial rows; the join back is on one row per value, which AQE can split.
The positions of one text are summed in one group, which is as large as that text's matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeline.operators.staging import stage

# fixed values: the patterns that the task states, and the kinds in their order
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# "of 20+ characters" and "of 24+" are the same as a longer minimum: these runs cannot be entered half-way
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BARE = r"[A-Za-z0-9+/_=-]{24,}"
OWNED = len(KINDS) - 1

_PART = "array<struct<kind:int,place:int,gap:int,size:int,counts:boolean,value:string,random:boolean>>"


def _parts(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Each match of a pattern with the length of the text since the match before it."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(whole.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("p"))

    def part(x: Column, place: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            place.alias("place"),
            F.length(x["p"]).alias("gap"),
            F.length(x["m"]).alias("size"),
            (F.length(x["v"]) >= least).alias("counts"),
            F.sha2(x["v"], 256).alias("value"),
            _random_looking(x["v"]).alias("random"),
        )

    # the text after the last match has none
    found = F.filter(F.transform(zipped, part), lambda x: x["size"].isNotNull())
    return F.when(text.rlike(pattern), found.cast(_PART)).otherwise(F.array().cast(_PART))


def _random_looking(value: Column) -> Column:
    """Letters and digits, and ten different characters or more."""
    kinds = F.array_remove(F.array_distinct(F.split(value, "")), "")
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(kinds) >= 10)


def document_parts(docs: DataFrame, text: str, id_col: str, repo: Column, owner: Column) -> DataFrame:
    """Pass one: (row, id, repo, owner, parts), without any text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        repo.cast("string").alias("repo"),
        owner.cast("string").alias("owner"),
        F.concat(_parts(t, ASSIGN, 0, 2, 6), _parts(t, ACCESS, 1), _parts(t, HEX, 2), _parts(t, BARE, OWNED)).alias("parts"),
    )


def candidates(parts: DataFrame) -> DataFrame:
    """(row, repo, owner, kind, start, stop, value, random): base spans, and random-looking bare ones that none of them overlaps."""
    each = parts.filter(F.size("parts") > 0).select("row", "repo", "owner", F.explode("parts").alias("p")).select("row", "repo", "owner", "p.*")
    upto = Window.partitionBy("row", "kind").orderBy("place")
    placed = each.repartition("row").withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(upto))
    placed = placed.withColumn("start", F.col("stop") - F.col("size")).filter(F.col("counts") & ((F.col("kind") < OWNED) | F.col("random")))
    # a base span overlaps if one that begins here or earlier ends later, or one that begins here or later begins before the end
    base = F.col("kind") < OWNED
    earlier = F.max(F.when(base, F.col("stop"))).over(Window.partitionBy("row").orderBy("start"))
    later = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.col("start").desc()))
    overlapped = F.coalesce(F.col("earlier") > F.col("start"), F.lit(False)) | F.coalesce(F.col("later") < F.col("stop"), F.lit(False))
    kept = placed.withColumn("earlier", earlier).withColumn("later", later).filter(base | ~overlapped)
    return kept.select("row", "repo", "owner", "kind", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "value", "random")


def ownership(each: DataFrame) -> DataFrame:
    """(value, n_owners, n_repos, n_rows) over all candidate values of the corpus; repositories are counted within their owner."""
    by_repo = each.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_rows"))


def scan(
    docs: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    repo: Column | None = None,
    owner: Column | None = None,
    copied_owners: int = 3,
    copied_repos: int = 6,
) -> DataFrame:
    """One row per document: id, and `spans`, array<struct<start, kind, stop, status, n_owners, n_repos>> by start and kind.

    status is `copied` (copied_owners owners or more, or several owners and copied_repos repositories or more),
    `live` (one owner, random-looking) or `shared`.
    """
    parts = stage(document_parts(docs, text, id_col, F.col("source") if repo is None else repo, F.col("source") if owner is None else owner), "secret-parts")
    each = stage(candidates(parts), "secret-candidates")
    widely = (F.col("n_owners") >= copied_owners) | ((F.col("n_owners") > 1) & (F.col("n_repos") >= copied_repos))
    status = F.when(widely, "copied").when((F.col("n_owners") == 1) & F.col("random"), "live").otherwise("shared")
    judged = each.join(ownership(each), "value").withColumn("status", status).filter((F.col("kind") < OWNED) | (F.col("status") == "live"))
    span = F.struct("start", "kind", "stop", "status", "n_owners", "n_repos")
    lists = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,status:string,n_owners:bigint,n_repos:bigint>>")
    return parts.select("row", "id").join(lists, "row", "left").select(F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans"))


def base_of(spans: Column) -> Column:
    """The spans of the base patterns."""
    return F.filter(spans, lambda s: s["kind"] < OWNED)


def having(field: str, value: int | str) -> Callable[[Column], Column]:
    """A condition on one field of a span; of one parameter, as a second one would be the span's place."""
    return lambda s: s[field] == value


def text_of(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined in the order given."""
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
