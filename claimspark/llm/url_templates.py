"""URL filters from rules and a path-template tree.

A url's verdict is that of the longest rule that fits; where none fits, that
of its template.  Templates form a tree per host: the path's first ``DEPTH`` - 1
segments, then all that follows as one more, so the whole path counts.  Variable
segments become wildcards, first by form (digit runs to ``*``), then by count:
under a node of more than ``max_children`` different children, those with less than
``min_share`` of its pages become ``*``.  Then, from the deepest level up, branches
under one node that have nearly the same distribution of what lies below them
and the same labels are merged: branches with the same largest part below are
compared with the largest of them, the anchor.  A node's purity is its share of good
pages among its labelled pages, smoothed by ``strength`` pseudo pages whose purity
is a mixture of its parent's (weight ``inherit``) and of the prior; pages
without a label weigh nothing.  Templates under ``threshold`` are blocked.  Labels
are the pages that a rule decides, or a table (page_id, bad).

Everything is DataFrame and SQL functions.  Scale: pages are reduced to counts
per template by partial aggregation; all tree work is joins and aggregations
on those counts, keyed by host and segments, so a large host spreads over its
branches.  The verdicts are broadcast if there are at most
``BROADCAST_TEMPLATES`` of them, else joined by a shuffle that adaptive execution
splits where a template is hot.  Similar branches are found by comparing each
with one anchor, never pairwise.

Defined cases: a null url or one without ``://`` has empty host and path and
still a template (the empty one).  A path under no slash fits no rule.  Equally
long rules that both fit: block wins.  Rows that repeat a page_id are judged
each; a label table's repeated page is bad if any of its rows is.  An empty
table gives an empty result.  Only page_id and url are read, so other columns
cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import stored

BROADCAST_TEMPLATES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of the tree under a host; the last holds the rest of the path.
DEPTH = 5
_LEVELS = range(1, DEPTH + 1)
_RAW = ["host", *[f"t{i}" for i in _LEVELS]]
_NODE = ["host", *[f"g{i}" for i in _LEVELS]]
_SHOWN = 3  # segments that a template's name always has


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Tree:
    max_children: int = 20
    min_share: float = 0.05
    similar: float = 0.9
    strength: float = 10.0
    inherit: float = 0.4
    prior: float = 0.9
    threshold: float = 0.5


#: The rules of the registered query.
RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"),
         Rule("allow", "org", "/fr/"))


def parsed(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(page_id, host, path, t1 .. tDEPTH, rule, ruled)."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rows = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    rows = rows.select("page_id", F.translate(F.regexp_extract("rest", "^([^/?#]*)", 1), _UPPER, _LOWER).alias("host"),
                       F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"))
    parts = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", "*"))
    rows = rows.withColumn("parts", parts)
    last = F.array_join(F.slice("parts", DEPTH, F.greatest(F.size("parts") - (DEPTH - 1), F.lit(0))), "/")
    segments = [F.coalesce(F.get("parts", F.lit(i - 1)), F.lit("")) for i in _LEVELS[:-1]] + [last]
    rule, ruled = fitting(rules)
    return rows.select("page_id", "host", "path", *[c.alias(f"t{i}") for i, c in zip(_LEVELS, segments)],
                       rule.alias("rule"), ruled.alias("ruled"))


def fitting(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block")):  # the last that fits wins
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name = F.when(fits, r.name).otherwise(name)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def shapes(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(host, t1 .. tDEPTH, n, bad, good): pages and labelled pages per path shape."""
    if labels is None:
        bad, good = F.col("ruled") == "block", F.col("ruled") == "allow"
    else:
        marks = labels.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("mark"))
        rows = rows.join(marks, "page_id", "left")
        bad, good = F.col("mark") == 1, F.col("mark") == 0
    return rows.groupBy(*_RAW).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(good).alias("good"))


def generalised(table: DataFrame, tree: Tree) -> DataFrame:
    """``table`` with g1 .. gDEPTH: the segments after the wildcards by count."""
    above = ["host"]
    for i in _LEVELS:
        raw, new = f"t{i}", f"g{i}"
        children = table.groupBy(*above, raw).agg(F.sum("n").alias("own"))
        parents = children.groupBy(*above).agg(F.sum("own").alias("whole"), F.count("*").alias("width"))
        rare = (children.join(parents, above).filter(
            (F.col("width") > tree.max_children) & (F.col("own") < tree.min_share * F.col("whole")) & (F.col(raw) != ""))
            .select(*above, raw, F.lit("*").alias(new)))
        table = stored(table.join(rare, [*above, raw], "left").withColumn(new, F.coalesce(new, raw)), f"url-level{i}")
        above = [*above, new]
    return table


def merged(table: DataFrame, tree: Tree) -> DataFrame:
    """``table`` with the names of merged branches in g1 .. gDEPTH, deepest level first."""
    for i in reversed(_LEVELS[:-1]):
        table = _merged_level(table, i, tree)
    return table


def _merged_level(table: DataFrame, level: int, tree: Tree) -> DataFrame:
    above, own = ["host", *[f"g{i}" for i in range(1, level)]], f"g{level}"
    deeper = [f"g{i}" for i in _LEVELS if i > level]
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    nodes = stored(table.groupBy(*above, own, F.concat_ws("/", *deeper).alias("below")).agg(*sums), "url-nodes")
    branches = nodes.groupBy(*above, own).agg(*sums, F.count("*").alias("kinds"), F.max(F.struct("n", "below"))["below"].alias("main"))
    empty = "/" * (len(deeper) - 1)  # nothing lies below: no structure to compare
    branches = stored(branches.filter(F.col("main") != empty), "url-branches")
    anchors = branches.groupBy(*above, "main").agg(F.max(F.struct("n", own, "bad", "good", "kinds")).alias("a"))
    pair = branches.join(anchors, [*above, "main"]).filter(F.col(own) != F.col(f"a.{own}"))
    shares = nodes.join(branches.select(*above, own, "main", F.col("n").alias("whole")), [*above, own]).select(
        *above, own, "main", "below", (F.col("n") / F.col("whole")).alias("share"))
    first = shares.join(anchors.select(*above, "main", F.col(f"a.{own}").alias(own)), [*above, "main", own]).select(
        *above, "main", "below", F.col("share").alias("anchor_share"))
    overlap = shares.join(first, [*above, "main", "below"]).groupBy(*above, own).agg(
        F.sum(F.least("share", "anchor_share")).alias("overlap"))
    unsure = F.sqrt(F.col("a.kinds") / (4.0 * F.col("n")))  # what chance alone takes from the overlap
    rate = lambda c: F.least(F.col(c) / F.col("n"), F.col(f"a.{c}") / F.col("a.n"))
    rest = F.least((F.col("n") - F.col("bad") - F.col("good")) / F.col("n"),
                   (F.col("a.n") - F.col("a.bad") - F.col("a.good")) / F.col("a.n"))
    same = (F.col("overlap") + unsure + 1e-9 >= tree.similar) & (rate("bad") + rate("good") + rest + 1e-9 >= tree.similar)
    alike = pair.join(overlap, [*above, own]).filter(same).select(*above, own, F.col(f"a.{own}").alias("branch"))
    out = table.join(alike, [*above, own], "left").withColumn(own, F.coalesce("branch", own)).drop("branch")
    return stored(out.select(*_RAW, *_NODE[1:], "n", "bad", "good"), f"url-merged{level}")


def purities(table: DataFrame, tree: Tree) -> DataFrame:
    """``table`` with the smoothed ``purity`` of each row's template."""
    sums = [F.sum(c).alias("s" + c) for c in ("bad", "good")]

    def smoothed(above: Column) -> Column:
        base = (1 - tree.inherit) * tree.prior + tree.inherit * above
        return (F.col("sgood") + tree.strength * base) / (F.col("sgood") + F.col("sbad") + tree.strength)

    whole = table.agg(*sums).select(smoothed(F.lit(tree.prior)).alias("p")).first()["p"]  # one number
    up, known = F.lit(whole if whole is not None else tree.prior), None
    for i in range(len(_NODE)):
        keys = _NODE[:i + 1]
        own = table.groupBy(*keys).agg(*sums)
        if known is not None:
            own, up = own.join(known, keys[:-1]), F.col("above")
        known = own.select(*keys, smoothed(up).alias("above"))
    return table.join(known, _NODE).withColumnRenamed("above", "purity")


def template_name() -> Column:
    """The segments, with slashes; empty ones beyond the third are left out."""
    return F.concat(F.concat_ws("/", *_NODE[1:_SHOWN + 1]),
                    *[F.when(F.col(g) != "", F.concat(F.lit("/"), F.col(g))).otherwise("") for g in _NODE[_SHOWN + 1:]])


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labels: DataFrame | None = None,
          tree: Tree = Tree()) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) per row."""
    rows = parsed(pages, rules)
    table = merged(generalised(stored(shapes(rows, labels), "url-shapes"), tree), tree)
    judged = stored(purities(table, tree).select(
        *_RAW, template_name().alias("template"), "purity"), "url-templates")
    if judged.count() <= BROADCAST_TEMPLATES:
        judged = F.broadcast(judged)
    by_template = F.when(F.col("purity") < tree.threshold, "block").otherwise("allow")
    return rows.join(judged, _RAW, "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_template).alias("verdict"), "template",
        F.round("purity", 6).alias("purity"))


def oracle(rules: tuple[Rule, ...] = RULES, tree: Tree = Tree()) -> str:
    """DuckDB SQL for ``judge`` with labels from the rules."""
    cases = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block"))
    fits = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN " for r in cases]
    rule = "CASE " + " ".join(f"{f}'{r.name}'" for f, r in zip(fits, cases)) + " END"
    ruled = "CASE " + " ".join(f"{f}'{r.verdict}'" for f, r in zip(fits, cases)) + " END"
    levels, above = [], "host"
    table = "shapes"
    for i in _LEVELS:
        levels.append(f"""
c{i} AS (SELECT {above}, t{i}, sum(n) AS own FROM {table} GROUP BY ALL),
l{i} AS (SELECT s.*, CASE WHEN p.width > {tree.max_children} AND c.own < {tree.min_share}::DOUBLE * p.whole AND s.t{i} <> ''
    THEN '*' ELSE s.t{i} END AS g{i}
  FROM {table} s JOIN c{i} c USING ({above}, t{i})
  JOIN (SELECT {above}, sum(own) AS whole, count(*) AS width FROM c{i} GROUP BY ALL) p USING ({above}))""")
        table, above = f"l{i}", f"{above}, g{i}"
    t = tree

    def smooth(alias: str, up: str) -> str:
        base = f"({(1 - t.inherit) * t.prior!r}::DOUBLE + {t.inherit}::DOUBLE * {up})"
        return f"({alias}.good + {t.strength}::DOUBLE * {base}) / ({alias}.good + {alias}.bad + {t.strength}::DOUBLE)"

    total = "sum(n) AS n, sum(bad) AS bad, sum(good) AS good"
    for i in reversed(_LEVELS[:-1]):
        up, own = ", ".join(["host", *[f"g{j}" for j in range(1, i)]]), f"g{i}"
        deeper = ", ".join(f"g{j}" for j in _LEVELS if j > i)
        empty = "/" * (DEPTH - i - 1)
        levels.append(f"""
n{i} AS (SELECT {up}, {own}, concat_ws('/', {deeper}) AS below, {total} FROM {table} GROUP BY ALL),
b{i} AS (SELECT {up}, {own}, {total}, count(*) AS kinds, max(row(n, below)) AS m FROM n{i} GROUP BY {up}, {own}),
s{i} AS (SELECT * EXCLUDE (m), m[2] AS main FROM b{i} WHERE m[2] <> '{empty}'),
a{i} AS (SELECT * FROM s{i} QUALIFY row_number() OVER (PARTITION BY {up}, main ORDER BY n DESC, {own} DESC) = 1),
h{i} AS (SELECT n{i}.*, b.main, n{i}.n::DOUBLE / b.n AS share FROM n{i} JOIN s{i} b USING ({up}, {own})),
f{i} AS (SELECT h{i}.* FROM h{i} JOIN a{i} USING ({up}, main, {own})),
o{i} AS (SELECT {', '.join('x.' + k.strip() for k in up.split(','))}, x.{own}, sum(least(x.share, f.share)) AS overlap
  FROM h{i} x JOIN f{i} f USING ({up}, main, below) GROUP BY ALL),
k{i} AS (SELECT {', '.join('b.' + k.strip() for k in up.split(','))}, b.{own}, a.{own} AS branch
  FROM s{i} b JOIN a{i} a USING ({up}, main) JOIN o{i} o ON {' AND '.join(f'o.{k.strip()} = b.{k.strip()}' for k in up.split(','))} AND o.{own} = b.{own}
  WHERE a.{own} <> b.{own} AND o.overlap + sqrt(a.kinds / (4.0::DOUBLE * b.n)) + 1e-9 >= {t.similar}::DOUBLE
    AND least(b.bad::DOUBLE / b.n, a.bad::DOUBLE / a.n) + least(b.good::DOUBLE / b.n, a.good::DOUBLE / a.n)
      + least((b.n - b.bad - b.good)::DOUBLE / b.n, (a.n - a.bad - a.good)::DOUBLE / a.n) + 1e-9 >= {t.similar}::DOUBLE),
m{i} AS (SELECT x.* EXCLUDE ({own}), coalesce(k.branch, x.{own}) AS {own} FROM {table} x LEFT JOIN k{i} k USING ({up}, {own}))""")
        table = f"m{i}"
    purity, above = [], "w"
    for i in range(len(_NODE)):
        keys = ", ".join(_NODE[:i + 1])
        joined = "w" if i == 0 else f"p{i - 1}"
        purity.append(f"p{i} AS (SELECT {', '.join('x.' + k for k in _NODE[:i + 1])}, {smooth('x', 'u.above')} AS above "
                      f"FROM (SELECT {keys}, {total} FROM tree GROUP BY {keys}) x "
                      + (f"CROSS JOIN {joined} u)" if i == 0 else f"JOIN {joined} u USING ({', '.join(_NODE[:i])}))"))
    raw = ", ".join(_RAW)
    name = "concat_ws('/', " + ", ".join(_NODE[1:_SHOWN + 1]) + ")" + "".join(
        f" || CASE WHEN {g} <> '' THEN '/' || {g} ELSE '' END" for g in _NODE[_SHOWN + 1:])
    segments = ", ".join([f"coalesce(parts[{i}], '') AS t{i}" for i in _LEVELS[:-1]]
                         + [f"coalesce(array_to_string(parts[{DEPTH}:], '/'), '') AS t{DEPTH}"])
    return f"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
    THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
p AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
    lambda s: regexp_replace(s, '[0-9]+', '*', 'g')) AS parts FROM u),
rows AS (SELECT page_id, host, path, {segments}, {rule} AS rule, {ruled} AS ruled FROM p),
shapes AS (SELECT {raw}, count(*) AS n, count(*) FILTER (WHERE ruled = 'block') AS bad,
    count(*) FILTER (WHERE ruled = 'allow') AS good FROM rows GROUP BY ALL),
{','.join(levels)},
tree AS (SELECT * FROM {table}),
w AS (SELECT {smooth('x', f'{t.prior}::DOUBLE')} AS above FROM (SELECT {total} FROM tree) x),
{', '.join(purity)},
judged AS (SELECT {raw}, {name} AS template, above AS purity FROM tree JOIN p{len(_NODE) - 1} USING ({', '.join(_NODE)}))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity < {t.threshold}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
  template, round(purity, 6) AS purity
FROM rows LEFT JOIN judged USING ({raw})"""
