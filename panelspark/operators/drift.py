"""Problem 5: schemas that drift between files, read into one table, with every lasting change reported.

Ingestion with a rescue column: each body is parsed once into a variant and the target schema is enforced field by
field, strictly by JSON type; what is unknown or of another type is kept as it came in ``_rescued``. Typed columns and
rescued fields together tell which fields each file holds, and from these come the changes: where fields begin and
end, which of them continue each other under a new name, over any number of renames, and where types change. Renames
are then promoted: rescued values are replayed into the typed columns of the fields they continue.

Parsing, casting and rescuing are row by row inside the JVM. Files meet twice: in blocks of file numbers, where each
field shrinks to where it begins, ends and how often it is met, and those few rows by stream. So a stream with a third
of all files is spread over its blocks, and what comes together by stream grows with its blocks and fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16_384  # file numbers that meet in one group; bounds it, whatever the size of a stream

# --- fixed values: the target schema of a study ------------------------------------------------------------------
TARGET = {
    "label": "string", "created_at": "string", "n_trials": "bigint", "n_trials_source": "string", "n_failed_trials": "bigint",
    "data_hash": "string", "data_description": "string", "verdict": "string", "deflated_sharpe": "double", "psr_vs_zero": "double",
    "sr0_expected_max": "double", "notes": "string", "schema_version": "string", "engine_version": "string",
    "performance.sharpe": "double", "performance.volatility": "double", "performance.max_drawdown": "double",
    "performance.n_obs": "bigint", "performance.skew": "double", "performance.kurtosis": "double", "performance.best_day": "double",
}
NESTED = "performance"
VERSIONS = ("schema_version", "engine_version")
# ----------------------------------------------------------------------------------------------------------------


#: JSON types by the first letters of a variant's schema; JSON null has none
_TYPES = "map('OBJEC', 'object', 'ARRAY', 'array', 'STRIN', 'string', 'BOOLE', 'boolean', 'BIGIN', 'number', 'DOUBL', 'number', 'FLOAT', 'number', 'DECIM', 'number')"


def _type(v: str) -> str:
    """string, number, boolean, array or object of a variant, as SQL; null for JSON null. (Long expressions are SQL texts: they are built in one call.)"""
    return f"try_element_at({_TYPES}, substring(schema_of_variant({v}), 1, 5))"


def _kind(cast: str) -> str:
    return cast if cast in ("string", "boolean") else "number"


def _column(name: str) -> str:
    return name.replace(".", "_")


def _path(name: str) -> str:
    return "$" + "".join(f'["{part}"]' for part in name.split("."))


def _texts(names) -> str:
    return "array(" + ", ".join(f"'{n}'" for n in names) + ")"


def ingest(df: DataFrame, target: dict[str, str], stream: str, no: str, file_id: str, received: str, body: str) -> DataFrame:
    """``stream_id, file_no, body, readable``, the target's columns under ``_t_`` names and ``rescued`` (name, v), per stream and file number.

    A value of the target's JSON type is typed (a fraction is no integer), any other field is rescued as a variant, JSON
    nulls among them, so that typed and rescued fields together are those of the file.
    """
    number = F.col(no).try_cast("bigint")
    rows = df.select(
        F.col(stream).cast("string").alias("stream_id"), number.alias("file_no"), F.floor(number / BLOCK).alias("_k"), F.col(received).alias("_r"), F.col(file_id).alias("_i"), F.col(body).cast("string").alias("_b")
    )
    # the only exchange of bodies; the grouping below and the blocks of the changes are at home in it
    one = rows.repartition("stream_id", "_k").groupBy("stream_id", "_k", "file_no").agg(F.min_by("_b", F.struct("_r", "_i")).alias("body"))
    one = one.selectExpr("*", "try_parse_json(body) AS v")
    whole = "if(startswith(schema_of_variant({0}), 'OBJECT'), try_variant_get({0}, '$', 'map<string,variant>'), NULL)"
    one = one.selectExpr("*", f"{whole.format('v')} AS top")
    one = one.selectExpr("*", f"{whole.format(f"try_element_at(top, '{NESTED}')")} AS nested")
    one = one.selectExpr("*", *[f"if(top IS NOT NULL, try_variant_get(v, '{_path(n)}', 'variant'), NULL) AS _v_{_column(n)}" for n in target])

    def strict(name: str, kind: str) -> str:
        v = f"_v_{_column(name)}"
        value, fits = f"try_variant_get({v}, '$', '{kind}')", f"{_type(v)} = '{_kind(kind)}'"
        return f"if({fits}{f" AND {value} = try_variant_get({v}, '$', 'double')" if kind == 'bigint' else ''}, {value}, NULL) AS _t_{_column(name)}"

    one = one.selectExpr("*", *[strict(n, kind) for n, kind in target.items()])
    landed = "array_compact(array(" + ", ".join(f"if(_t_{_column(n)} IS NOT NULL, '{n}', NULL)" for n in target) + "))"
    entries = "transform(map_entries({0}), e -> struct(concat('{1}', e.key) AS name, e.value AS v))".format
    one = one.selectExpr("*", f"{landed} AS landed", f"if(nested IS NULL, {entries('top', '')}, concat({entries('top', '')}, {entries('nested', NESTED + '.')})) AS fields")
    typed = [f"_t_{_column(n)}" for n in target]
    return one.selectExpr("stream_id", "_k", "file_no", "body", "top IS NOT NULL AS readable", *typed, "filter(fields, f -> NOT array_contains(landed, f.name)) AS rescued")


def _lives(files: DataFrame, target: dict[str, str]) -> DataFrame:
    """``stream_id, name, parent, n, c, lo, hi, lo_no, gone_no, types``: per stream and field the positions of its first and last
    file among the stream's ``n``, the number of files that hold it, the number of its first file and of the first one after its
    last, and the same of each JSON type it has."""
    known = files.where("stream_id IS NOT NULL AND file_no IS NOT NULL AND readable")
    typed = ", ".join(f"if(_t_{_column(n)} IS NOT NULL, struct('{n}' AS name, '{_kind(kind)}' AS jtype), NULL)" for n, kind in target.items())
    kept = f"transform(rescued, f -> struct(f.name AS name, {_type('f.v')} AS jtype))"
    every = "array(struct(CAST(NULL AS STRING) AS name, CAST(NULL AS STRING) AS jtype))"  # counts the files themselves
    w = Window.partitionBy("stream_id", "_k").orderBy("file_no")
    held = F.expr(f"concat({every}, array_compact(array({typed})), {kept})")
    fields = known.select("stream_id", "_k", "file_no", F.row_number().over(w).alias("r"), F.lead("file_no").over(w).alias("next"), held.alias("f"))
    fields = fields.select("stream_id", "_k", "file_no", "r", "next", F.explode("f").alias("f")).select("*", "f.*")
    part = fields.groupBy("stream_id", "_k", "name", "jtype").agg(
        F.count("*").alias("c"), F.min(F.struct("r", "file_no")).alias("a"), F.max(F.struct("r", "next")).alias("z")
    )
    # by stream: a row per block, field and type
    part = part.repartition("stream_id")
    whole = F.col("name").isNull()
    up, down = (Window.partitionBy("stream_id").orderBy(o).rangeBetween(Window.unboundedPreceding, -1) for o in ("_k", F.desc("_k")))
    part = part.select(
        "stream_id", "name", "jtype", "c", "a", "z",
        F.coalesce(F.sum(F.when(whole, F.col("c"))).over(up), F.lit(0)).alias("before"),
        F.min(F.when(whole, F.col("a.file_no"))).over(down).alias("next"),
        F.sum(F.when(whole, F.col("c"))).over(Window.partitionBy("stream_id")).alias("n"),
    ).where("name IS NOT NULL")
    part = part.select(
        "stream_id", "name", "jtype", "n", "c",
        F.struct((F.col("a.r") + F.col("before")).alias("r"), F.col("a.file_no").alias("no")).alias("a"),
        F.struct((F.col("z.r") + F.col("before")).alias("r"), F.coalesce("z.next", "next").alias("no")).alias("z"),
    )
    types = part.groupBy("stream_id", "name", "jtype").agg(F.max("n").alias("n"), F.sum("c").alias("c"), F.min("a").alias("a"), F.max("z").alias("z"))
    spans = F.array_sort(F.collect_list(F.when(F.col("jtype").isNotNull(), F.struct(F.col("a.r").alias("lo"), F.col("z.r").alias("hi"), "jtype", F.col("a.no").alias("no")))))
    lives = types.groupBy("stream_id", "name").agg(F.max("n").alias("n"), F.sum("c").alias("c"), F.min("a").alias("a"), F.max("z").alias("z"), spans.alias("types"))  # at most five types
    parent = F.when(F.col("name").contains("."), F.substring_index("name", ".", 1)).otherwise("")
    return lives.select("stream_id", "name", parent.alias("parent"), "n", "c", F.col("a.r").alias("lo"), F.col("z.r").alias("hi"), F.col("a.no").alias("lo_no"), F.col("z.no").alias("gone_no"), "types")


def field_changes(
    df: DataFrame, target: dict[str, str] | None = None, stream: str = "stream_id", no: str = "file_no", file_id: str = "file_id", received: str = "received_at", body: str = "body"
) -> DataFrame:
    """``stream_id, file_no, field_name, change_kind, new_name, origin, lasting``: every change of each stream's fields.

    A field has a life if no file between its first and its last lacks it, and if it is met in two files at least or in
    the stream's first or last one. ``lasting`` changes are those that :func:`schema_changes` defines. The others
    (``lasting`` false) are what happens in between: a field ``added`` that ends later, ``removed`` that began later, and
    ``renamed`` where one of the two names doesn't last, such as each step of a chain of renames. A chain's first name is
    besides ``removed`` and its last one ``added`` for good, which are lasting changes. ``origin`` is the name under which
    the field began, over all renames. Nulls, repeats and empty tables as there.
    """
    target = TARGET if target is None else target
    lives = _lives(ingest(df, target, stream, no, file_id, received, body), target)
    alive = "c = hi - lo + 1 AND (c > 1 OR lo = 1 OR hi = n)"
    begin = "struct(lo AS r, lo_no AS no, name, parent, try_element_at(types, 1).jtype AS jtype, hi = n AS strict)"
    end = "struct(hi + 1 AS r, gone_no AS no, name, parent, try_element_at(types, -1).jtype AS jtype, lo = 1 AS strict)"
    turns = "filter(transform(slice(types, 2, 16), (t, i) -> struct(t.no AS no, name, types[i].hi < t.lo AS clean)), t -> t.clean)"
    # the fields of a stream that begin, end or turn: as many as its schema has changes
    streams = lives.groupBy("stream_id").agg(
        F.expr(f"collect_list(if({alive} AND lo > 1, {begin}, NULL)) AS begins"),
        F.expr(f"collect_list(if({alive} AND hi < n, {end}, NULL)) AS ends"),
        F.expr(f"flatten(collect_list({turns})) AS turns"),
    )
    pair = "struct(int(NOT (e.strict AND b.strict)) AS loose, levenshtein(lower(e.name), lower(b.name)) AS d, e.name AS old, b.name AS new, e.r AS r, b.no AS no)"
    same = "e.r = b.r AND e.parent = b.parent AND e.jtype = b.jtype"
    streams = streams.selectExpr("*", f"array_sort(flatten(transform(ends, e -> transform(filter(begins, b -> {same}), b -> {pair})))) AS pairs")
    none_yet = "CAST(array() AS array<struct<loose:int,d:int,old:string,new:string,r:bigint,no:bigint>>)"
    streams = streams.selectExpr("*", f"aggregate(pairs, {none_yet}, (got, p) -> if(exists(got, g -> g.old = p.old OR g.new = p.new), got, concat(got, array(p)))) AS renames")
    # origins in order of time, so that each step knows that of the one before
    origin = "coalesce(try_element_at(filter({0}, h -> h.name = {1}), 1).origin, {1})".format
    in_time = "array_sort(transform(renames, p -> struct(p.r, p.old, p.new)))"
    streams = streams.selectExpr("*", f"aggregate({in_time}, CAST(array() AS array<struct<name:string,origin:string>>), (got, p) -> concat(got, array(struct(p.new AS name, {origin('got', 'p.old')} AS origin)))) AS homes")

    def change(one: str, name: str, kind: str, new: str, lasting: str) -> str:
        return f"struct({one}.no AS file_no, {one}.{name} AS field_name, '{kind}' AS change_kind, {new} AS new_name, {origin('homes', f'{one}.{name}')} AS origin, {lasting} AS lasting)"

    def one_sided(events: str, side: str, kind: str) -> str:
        alone = f"NOT exists(renames, p -> p.{side} = e.name AND (p.loose = 0 OR NOT e.strict))"
        return f"transform(filter({events}, e -> {alone}), e -> {change('e', 'name', kind, "''", 'e.strict')})"

    events = ", ".join([
        one_sided("begins", "new", "added"), one_sided("ends", "old", "removed"),
        f"transform(renames, p -> {change('p', 'old', 'renamed', 'p.new', 'p.loose = 0')})", f"transform(turns, t -> {change('t', 'name', 'type_changed', "''", 'true')})",
    ])
    return streams.selectExpr("stream_id", f"explode(concat({events})) AS e").select("stream_id", "e.*")


def schema_changes(df: DataFrame, target: dict[str, str] | None = None, **columns: str) -> DataFrame:
    """``stream_id, file_no, field_name, change_kind, new_name``: the lasting changes of each stream's fields.

    * ``file_no`` is that of the first changed file; fields are top-level ones and those directly in ``performance``;
    * ``added``: in no earlier and every later file; ``removed``: the reverse; ``renamed``: one of each in one file with one
      JSON type and one parent (where several qualify, names that are closest to each other pair up first), as one row;
      ``type_changed``: the type before is not met again and the new one was not met before;
    * a field absent or null now and then is no change; JSON null has no type, all numbers are one type;
    * repeated files count once, by their first arrival; a body that is null or no JSON object is no file of its stream;
      rows with a null stream or number are left out; a stream of one file has no change; an empty table gives no rows.
    """
    return field_changes(df, target, **columns).where("lasting").drop("origin", "lasting")


def _version(text: str) -> str:
    return f"regexp_replace(lower(trim({text})), '^v(?:ersion)?[ ]*', '')"


def version_text(v: str) -> str:
    """One form of a version, as SQL: 1.10 from text, number, array of parts or an object with major, minor and patch."""
    parts = ", ".join(f"try_variant_get({v}, '$.{k}', 'string')" for k in ("major", "minor", "patch"))
    text = _version(f"try_variant_get({v}, '$', 'string')")
    return f"CASE {_type(v)} WHEN 'array' THEN array_join(try_variant_get({v}, '$', 'array<string>'), '.') WHEN 'object' THEN nullif(array_join(array_compact(array({parts})), '.'), '') ELSE {text} END"


def read_studies(
    df: DataFrame,
    approved: DataFrame | None = None,
    target: dict[str, str] | None = None,
    stream: str = "stream_id",
    no: str = "file_no",
    file_id: str = "file_id",
    received: str = "received_at",
    body: str = "body",
) -> DataFrame:
    """One typed row per stream and file number: the target's columns (dots become underscores) and ``_rescued``.

    ``_rescued`` holds as JSON every field that is unknown or can't be cast, the whole body where it is no JSON object
    (under ``_body``), and is null where nothing was rescued. ``approved`` (``stream_id, field_name, new_name``, such as
    the renamed rows of :func:`field_changes`) promotes rescued fields: along any chain of renames, back or forth, to a
    name of the target, their values are replayed into its column and leave ``_rescued`` where the cast succeeds. A
    rescued value of a target's own name is replayed too, so numbers written as text land. Repeated files count once, by
    their first arrival; null streams and numbers are kept; a missing or null field is null; an empty table gives no rows.
    """
    target = TARGET if target is None else target
    files = ingest(df, target, stream, no, file_id, received, body)
    if approved is not None:
        links = F.collect_set(F.struct(F.col("field_name").alias("old"), F.col("new_name").alias("new")))
        steps = approved.groupBy("stream_id").agg(links.alias("links")).selectExpr("*", f"{_texts(target)} AS goals")
        steps = steps.selectExpr("*", "array_except(array_distinct(flatten(transform(links, p -> array(p.old, p.new)))), goals) AS names")

        def closed(a: str, b: str) -> str:
            """Every name of a stream with the target's name it leads to: as many rounds as there are renames close any chain."""
            step = f"if(array_contains(goals, g.v), g.v, coalesce(try_element_at(filter(links, p -> p.{a} = g.v), 1).{b}, g.v))"
            return f"aggregate(links, transform(names, n -> struct(n AS k, n AS v)), (got, _) -> transform(got, g -> struct(g.k AS k, {step} AS v)))"

        alias = f"filter(concat({closed('new', 'old')}, {closed('old', 'new')}), g -> array_contains(goals, g.v)) AS alias"
        files = files.join(steps.selectExpr("stream_id", alias), "stream_id", "left")
    else:
        files = files.selectExpr("*", "CAST(NULL AS array<struct<k:string,v:string>>) AS alias")
    home = "coalesce(try_element_at(filter(alias, a -> a.k = f.name), 1).v, f.name)"
    files = files.withColumn("rescued", F.expr(f"transform(coalesce(rescued, array()), f -> struct(f.name AS name, {home} AS home, f.v AS v))"))

    def cast(name: str, kind: str) -> str:
        if name in VERSIONS:
            return version_text("f.v")
        value = f"try_variant_get(f.v, '$', '{kind}')"
        fits = {"string": f"{_type('f.v')} IN ('string', 'number', 'boolean')", "bigint": f"{value} = try_variant_get(f.v, '$', 'double')"}.get(kind)
        return f"if({fits}, {value}, NULL)" if fits else value

    def final(name: str, kind: str) -> str:
        own = f"_t_{_column(name)}"
        replayed = f"try_element_at(array_compact(transform(filter(rescued, f -> f.home = '{name}'), f -> {cast(name, kind)})), 1)"
        return f"coalesce({_version(own) if name in VERSIONS else own}, {replayed}) AS _f_{_column(name)}"

    files = files.selectExpr("*", *[final(n, kind) for n, kind in target.items()])
    full = "array_compact(array(" + ", ".join(f"if(_t_{_column(n)} IS NULL AND _f_{_column(n)} IS NOT NULL, '{n}', NULL)" for n in target) + "))"
    files = files.selectExpr("*", f"{full} AS full")
    files = files.selectExpr("*", f"filter(rescued, f -> NOT array_contains(full, f.home) AND {_type('f.v')} IS NOT NULL AND f.name <> '{NESTED}') AS left")
    unread = "if(body IS NOT NULL, to_json(map('_body', body)), NULL)"
    kept = "if(size(left) > 0, to_json(map_from_entries(transform(left, f -> struct(f.name, to_json(f.v))))), NULL)"
    return files.selectExpr("stream_id", "file_no", *[f"_f_{_column(n)} AS {_column(n)}" for n in target], f"if(NOT readable, {unread}, {kept}) AS _rescued")
