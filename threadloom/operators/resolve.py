"""Resolution of many names of projects at once: one plan for a table of identifiers, no driver action.

What a project answers to is exploded into keys, the keys are joined with the identifiers' distinct keys, and the first tier
that has an answer wins. A key that means several different places is reduced to its smallest and largest place before any join, so a name that
a third of all projects share costs one row; that it is ambiguous is a column (``problem``) and stops no other identifier.

Nulls: a null identifier is as an empty one and means itself; a project's null name or path is as an empty one. Identifiers that come twice come once
in the result; empty tables give empty results (no projects: each identifier means itself).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import basename, git_remote, project_aliases, strip
from threadloom.operators.rollups import project_order


def git_key(urls: Column) -> Column:
    """A set of git remotes, normalised: trimmed, without ``.git`` ends, lower case, ascending, once each."""
    return F.array_sort(F.array_distinct(F.transform(urls, git_remote)))


def _remote_set(urls: Column) -> Column:
    """One value for a set of remotes; null for none. JSON keeps borders between remotes apart from what stands in them."""
    return F.when(F.size(urls) > 0, F.sha2(F.to_json(git_key(urls)), 256))


def _filled(projects: DataFrame) -> DataFrame:
    none = F.lit("")
    name, path = F.coalesce("project_name", none), F.coalesce("project_path", none)
    return projects.withColumns({"project_name": name, "project_path": path}).withColumn("_place", F.when(F.col("project_path") == "", F.col("project_name")).otherwise(F.col("project_path")))


def _keyed(projects: DataFrame, keys: Column, *columns: str) -> DataFrame:
    """A row for each project and different key of it."""
    return projects.select(F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("_key"), *columns)


def _places(keyed: DataFrame) -> DataFrame:
    """(_key, _low, _high): the smallest and the largest place of a key; they differ where it is ambiguous."""
    return keyed.groupBy("_key").agg(F.min("_place").alias("_low"), F.max("_place").alias("_high"))


def spellings(name: Column) -> Column:
    """A name with and without the slashes that it begins with."""
    bare = F.regexp_replace(name, r"\A/+", "")
    return F.array_distinct(F.when(~F.startswith(name, F.lit("/")), F.array(name, F.concat(F.lit("/"), name))).otherwise(F.array(name, F.when(bare != "", bare).otherwise(name))))


def resolve_names(projects: DataFrame, identifiers: DataFrame, aliases: Column | None = None) -> DataFrame:
    """(identifier, tier, names, problem), one row per different ``identifier``: the project names that it means, ascending.

    Tier ``exact``: per source the first project (by name) for each spelling that is a name or path. Else ``alias``: all names of the one
    place with such an alias (the identifier, or its last path component); aliases of several places are a problem, without names.
    Else ``itself``. White space around an identifier doesn't count, but an unknown one stays as it is.
    ``aliases``: what else a project answers to, by default ``project_aliases``.
    """
    known = _filled(projects)
    asked = identifiers.select(F.coalesce("identifier", F.lit("")).alias("identifier")).distinct().withColumn("_name", strip(F.col("identifier")))
    named = asked.where("_name <> ''")
    own = _keyed(known, F.array("project_name", "project_path"), "source", "project_name").groupBy("_key", "source").agg(F.min("project_name").alias("_n"))
    spelled = named.select("identifier", F.explode(spellings(F.col("_name"))).alias("_key"))
    exact = spelled.join(own, "_key").groupBy("identifier").agg(F.array_sort(F.collect_set("_n")).alias("_exact"))

    other = known.withColumn("_also", aliases if aliases is not None else project_aliases(F.col("project_name"), F.col("project_path")))
    also = _keyed(other, F.col("_also"), "_place", "project_name")
    single = _places(also)
    # names only of keys with one place
    names = also.join(single.where("_low = _high").select("_key"), "_key").groupBy("_key").agg(F.collect_set("project_name").alias("_names"))
    answers = single.join(names, "_key", "left")
    looked = named.select("identifier", F.explode(F.array_distinct(F.array("_name", F.coalesce(basename(F.col("_name")), F.col("_name"))))).alias("_key"))
    alias = looked.join(answers, "_key").groupBy("identifier").agg(
        F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_names")))).alias("_alias")
    )
    rows = asked.join(exact, "identifier", "left").join(alias, "identifier", "left")
    first, second = F.col("_exact").isNotNull(), F.col("_low").isNotNull()
    unclear = ~first & second & (F.col("_low") != F.col("_high"))
    told = F.concat(F.lit('multiple projects matched alias "'), F.coalesce(basename(F.col("_name")), F.col("_name")), F.lit('"; pass an exact project path'))
    itself = F.array(F.when(F.col("_name") == "", F.col("_name")).otherwise(F.col("identifier")))
    return rows.select(
        "identifier",
        F.when(first, "exact").when(second, "alias").otherwise("itself").alias("tier"),
        F.when(unclear, F.lit(None)).when(first, F.col("_exact")).when(second, F.col("_alias")).otherwise(itself).alias("names"),
        F.when(unclear, told).alias("problem"),
    )


def resolve_peers(projects: DataFrame, asked: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """(git_remotes, local_path, display_name, tier, path, problem): under which path a peer knows each project that is asked for.

    ``projects``: of the peer, with ``git_remotes`` and ``aliases``. ``asked``: git_remotes, local_path, display_name; different rows come once.
    Tier ``remotes``: the same set of remotes. Else ``path``: the first project in ``order`` (newest first) with this name or path. Else ``name``: a
    name, last component or alias. Else ``itself``: the local path. Several answers of one tier, by remotes or by name, are a problem, without a path.
    """
    known = _filled(projects)
    keys = ["git_remotes", "local_path", "display_name"]
    none = F.array().cast("array<string>")
    rows = asked.select(F.coalesce("git_remotes", none).alias("git_remotes"), *[F.coalesce(k, F.lit("")).alias(k) for k in keys[1:]]).distinct()
    rows = rows.withColumn("_remotes", _remote_set(F.col("git_remotes")))

    by_remotes = known.where("project_path <> ''").select(_remote_set(F.col("git_remotes")).alias("_key"), "_place").where("_key is not null")
    newest = Window.partitionBy("_key").orderBy(*(order if order is not None else project_order()))
    ordered = _keyed(known, F.array("project_name", "project_path"), *dict.fromkeys(c for c in known.columns))
    by_path = ordered.withColumn("_r", F.row_number().over(newest)).where("_r = 1").select(F.col("_key").alias("local_path"), F.col("_place").alias("_path"))
    called = F.concat(F.array("project_name", basename(F.col("project_name")), basename(F.col("project_path"))), F.coalesce("aliases", none))
    by_name = _keyed(known, called, "_place")

    def renamed(places: DataFrame, key: str, mark: str) -> DataFrame:
        return places.select(F.col("_key").alias(key), F.col("_low").alias(f"{mark}_low"), F.col("_high").alias(f"{mark}_high"))

    found = rows.join(renamed(_places(by_remotes), "_remotes", "_r"), "_remotes", "left").join(by_path, "local_path", "left")
    found = found.join(renamed(_places(by_name), "display_name", "_n"), "display_name", "left")
    remotes, path, name = F.col("_r_low").isNotNull(), F.col("_path").isNotNull(), F.col("_n_low").isNotNull()
    tier = F.when(remotes, "remotes").when(path, "path").when(name, "name").otherwise(F.lit("itself"))
    several = lambda mark, what: F.when(
        F.col(f"{mark}_low") != F.col(f"{mark}_high"), F.concat(F.lit(f"multiple remote projects matched {what} for "), "display_name", F.lit("; pass an explicit project"))
    )
    problem = F.when(remotes, several("_r", "git remotes")).when(path, F.lit(None)).when(name, several("_n", "display name"))
    answer = F.when(remotes, F.col("_r_low")).when(path, F.col("_path")).when(name, F.col("_n_low")).otherwise(F.col("local_path"))
    return found.withColumns({"tier": tier, "problem": problem}).select(*keys, "tier", F.when(F.col("problem").isNull(), answer).alias("path"), "problem")
