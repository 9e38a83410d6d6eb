"""Artefact files of runs: the catalogue, complete sets, newest files, and the import of cache entries into valid epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrace.functions import text

#: File name before the tag -> kind.
PREFIXES = {"traj_samples_": "traj", "param_samples_": "param", "logp_": "logp"}


def listed(spark: SparkSession, root: str, files: str = "*.dat") -> DataFrame:
    """path, changed, length of all files below a root whose name fits the pattern. Contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files).load(root)
    return rows.select("path", F.col("modificationTime").alias("changed"), "length")


def catalogue(files: DataFrame) -> DataFrame:
    """`files(path, ...)` that are artefacts, with parent, name, kind, tag and trial of `<prefix><tag>[_trial<n>].dat`; null without a trial."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    rows = files.select("*", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("parent"), name.alias("name"))
    prefix = F.regexp_extract("name", f"^({'|'.join(PREFIXES)}).*[.]dat$", 1)
    kind = F.lit(None).cast("string")
    for p, k in PREFIXES.items():
        kind = F.when(prefix == p, k).otherwise(kind)
    token = F.trim(F.regexp_replace(F.regexp_replace("name", f"^({'|'.join(PREFIXES)})", ""), "[.]dat$", ""))
    rows = rows.withColumn("kind", kind).withColumn("_token", token).where("kind is not null and _token <> ''")
    own = F.regexp_extract("_token", "^(.*)_trial([0-9]+)$", 1)
    tag = F.trim(F.when(F.col("_token").rlike("^.*_trial[0-9]+$"), own).otherwise(F.col("_token")))
    return rows.withColumn("tag", tag).withColumn("trial", F.regexp_extract("_token", "^.*_trial([0-9]+)$", 1).try_cast("long")).drop("_token").where("tag <> ''")


def index(files: DataFrame) -> DataFrame:
    """Per tag and trial of a catalogue the number of files of each kind: tag, trial, traj, param, logp."""
    return files.groupBy("tag", "trial").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in PREFIXES.values()])


def newest(files: DataFrame, by: list[str], pattern: str | None = None) -> DataFrame:
    """The file that changed last in each group, of equals the one with the first path; with `pattern` among names that fit it (`*`: any text)."""
    if pattern is not None:
        files = files.where(F.regexp_extract("path", "([^/]*)$", 1).rlike("^" + ".*".join(map(_quoted, pattern.split("*"))) + "$"))
    rest = [c for c in files.columns if c not in by]
    best = files.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct((-F.unix_micros(F.col("changed").cast("timestamp"))).alias("o"), "path")).alias("b"))
    return best.select(*by, *[F.col(f"b.{c}").alias(c) for c in rest])


def _quoted(part: str) -> str:
    return f"\\Q{part}\\E" if part else ""


def pick_trial_files(wanted: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """The file of a kind for each wanted(id, tag, trial): tag and trial exactly, else the newest whose trial begins with that number.

    Without a trial the newest of the tag's trials, else the tag's file without one. `files` is a catalogue with `changed`.
    """
    own = files.where(F.col("kind") == kind)
    both = wanted.join(own.select("tag", F.col("trial").alias("_trial"), "path", "changed"), "tag")
    exact = F.col("trial") == F.col("_trial")
    longer = F.coalesce(F.startswith(F.col("_trial").cast("string"), F.col("trial").cast("string")), F.lit(False))
    place = F.when(F.col("trial").isNull(), F.when(F.col("_trial").isNotNull(), 0).otherwise(1)).when(exact, 0).when(longer, 1)
    order = F.struct("_place", (-F.unix_micros(F.col("changed").cast("timestamp"))).alias("o"), "path")
    return both.withColumn("_place", place).where("_place is not null").groupBy("id").agg(F.min_by("path", order).alias("path"))


def complete_sets(files: DataFrame) -> DataFrame:
    """Per tag the parent folder with trajectory and parameter files that has most of these, then most files, then the last name:
    tag, parent, required, files."""
    per = files.groupBy("tag", "parent").agg(F.count_if(F.col("kind") == "traj").alias("traj"), F.count_if(F.col("kind") == "param").alias("param"), F.count("*").alias("files"))
    per = per.where("traj > 0 and param > 0").withColumn("required", F.col("traj") + F.col("param"))
    return per.groupBy("tag").agg(F.max(F.struct("required", "files", "parent")).alias("best")).select("tag", "best.*")


def complete_trials(files: DataFrame, by: list[str]) -> DataFrame:
    """The trials (0 without one) of each group that have a trajectory and a parameter file: *by, trial, n (all files of the trial)."""
    per = files.groupBy(*by, F.coalesce("trial", F.lit(0)).cast("long").alias("trial"))
    per = per.agg(F.count_if(F.col("kind") == "traj").alias("a"), F.count_if(F.col("kind") == "param").alias("b"), F.count("*").alias("n"))
    return per.where("a > 0 and b > 0").select(*by, "trial", "n")


def sets_with_trials(files: DataFrame) -> DataFrame:
    """`complete_sets` with `complete`: how many trials of the chosen parent have both kinds of files."""
    whole = complete_trials(files, ["tag", "parent"]).groupBy("tag", "parent").agg(F.count("*").alias("complete"))
    return complete_sets(files).join(whole, ["tag", "parent"], "left").withColumn("complete", F.coalesce("complete", F.lit(0)))


def sets_of_tags(tags: DataFrame, sets: DataFrame) -> DataFrame:
    """The set of complete artefacts for each tag: under the tag itself, else its stem before `_epoch`, its epoch id, or that id's stem."""
    t = F.col("tag")
    stem = lambda x: F.regexp_replace(x, "_epoch.*$", "")
    names = F.filter(F.array_distinct(F.array(t, stem(t), text.tag_epoch(t), stem(text.tag_epoch(t)))), lambda n: n != "")
    tried = tags.select("tag", F.posexplode(names).alias("place", "name")).join(sets.withColumnRenamed("tag", "name"), "name")
    rest = [c for c in sets.columns if c != "tag"]
    return tried.groupBy("tag").agg(F.min(F.struct("place", "name", *rest)).alias("b")).select("tag", F.col("b.name").alias("found_as"), *[F.col(f"b.{c}").alias(c) for c in rest])


def stems_of(epochs: DataFrame) -> DataFrame:
    """The dataset stems of epoch ids `<stem>_epoch<n>`; ids of another form have none."""
    return epochs.select(F.regexp_extract("epoch", "^(.*)_epoch[0-9]+$", 1).alias("stem"), F.col("epoch").rlike("^.*_epoch[0-9]+$").alias("ok")).where("ok").select("stem").distinct()


def tag_prefixes(tag: Column) -> Column:
    """The tag and its first parts that end before a `_`."""
    parts = F.split(tag, "_")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))


def longest_stem(tags: DataFrame, stems: DataFrame) -> DataFrame:
    """tag and stem: the longest stem that is the tag or that the tag goes on from with `_`. Tags without one drop out."""
    tried = tags.select("tag").distinct().select("tag", F.explode(tag_prefixes(F.col("tag"))).alias("stem")).join(stems.select("stem").distinct(), "stem")
    return tried.groupBy("tag").agg(F.max_by("stem", F.length("stem")).alias("stem"))


def epoch_tag(tag: Column, stem: Column, number: Column) -> Column:
    """The tag with `_epoch<number>` after its stem."""
    at = F.concat(stem, F.lit("_epoch"), number.cast("string"))
    return F.when(F.startswith(tag, F.concat(stem, F.lit("_"))), F.concat(at, F.substring(tag, F.length(stem) + 1, F.length(tag)))).otherwise(at)


def remap_tags(tags: DataFrame, stems: DataFrame, epochs: DataFrame | None = None) -> DataFrame:
    """Longest dataset stem of each tag(tag, trial), and the epoch id of its trial (epoch 1 without a trial): tag, trial, stem, epoch.

    Where the valid `epochs(epoch)` are given, an id that is not among them becomes the stem's epoch 1 if that is valid; else the tag drops out.
    """
    best = tags.select("tag", "trial").join(longest_stem(tags, stems), "tag").withColumn("epoch", F.concat("stem", F.lit("_epoch"), (F.coalesce("trial", F.lit(0)) + 1).cast("string")))
    if epochs is None:
        return best
    valid = epochs.select("epoch").distinct()
    tried = best.withColumn("default", F.concat("stem", F.lit("_epoch1"))).join(valid.withColumn("ok", F.lit(True)), "epoch", "left")
    tried = tried.join(valid.select(F.col("epoch").alias("default"), F.lit(True).alias("default_ok")), "default", "left")
    return tried.where("ok or default_ok").select("tag", "trial", "stem", F.when(F.col("ok"), F.col("epoch")).otherwise(F.col("default")).alias("epoch"))


def import_targets(entries: DataFrame, epochs: DataFrame, files: DataFrame, existing: DataFrame, need_outputs: bool = False, overwrite: bool = False) -> DataFrame:
    """What becomes of each cache entry(folder, tag, key): folder, tag, key, and for each target epoch, target_tag, target_key, trial, remapped,
    outputs (artefact files that come along), exists; one row with a null epoch for an entry without a target.

    A valid epoch id of the tag is the target. Else each complete trial n of the tag's artefacts has the epoch n + 1 of its longest stem, as
    far as valid; if none is, epoch 1 with the artefacts of trial 0. Without valid epochs every tag's own is. With `need_outputs`
    entries without artefacts are `unmatched` and get no target. `exists`: `existing(folder, key)` has the target key (never with `overwrite`).
    """
    sets = complete_sets(files)
    found = sets_of_tags(entries.select("tag").distinct(), sets).select("tag", "found_as", "parent")
    own = found.join(files.select(F.col("tag").alias("found_as"), "parent", "kind", F.coalesce("trial", F.lit(0)).cast("long").alias("trial")), ["found_as", "parent"])
    by_trial = complete_trials(own, ["tag"])
    outputs = own.groupBy("tag").agg(F.count("*").alias("all_outputs")).join(by_trial.groupBy("tag").agg(F.map_from_entries(F.collect_list(F.struct("trial", "n"))).alias("trials")), "tag", "left")
    valid = epochs.select("epoch").distinct()
    any_valid = not epochs.isEmpty()
    rows = entries.join(outputs, "tag", "left").join(longest_stem(entries, stems_of(epochs)), "tag", "left").withColumn("own_epoch", text.tag_epoch(F.col("tag")))
    rows = rows.withColumn("unmatched", F.lit(need_outputs) & F.col("all_outputs").isNull())
    rows = rows.join(valid.select(F.col("epoch").alias("own_epoch"), F.lit(True).alias("direct")), "own_epoch", "left").withColumn("direct", F.coalesce("direct", F.lit(not any_valid)) & ~F.col("unmatched"))
    target = lambda epoch, tag, key, trial, remapped, n, kind: F.struct(epoch.alias("epoch"), tag.alias("target_tag"), key.alias("target_key"), trial.cast("long").alias("trial"), F.lit(remapped).alias("remapped"), F.coalesce(n, F.lit(0)).cast("long").alias("outputs"), F.lit(kind).alias("way"))
    tag, key, stem = F.col("tag"), F.col("key"), F.col("stem")
    mapped = lambda e, way: target(F.concat(stem, F.lit("_epoch"), (e["key"] + 1).cast("string")), epoch_tag(tag, stem, e["key"] + 1), F.concat(key, F.lit("_trial"), e["key"].cast("string")), e["key"], True, e["value"], way)
    direct = F.array(target(F.col("own_epoch"), tag, key, F.lit(None), False, F.col("all_outputs"), "direct"))
    by_map = F.transform(F.map_entries("trials"), lambda e: mapped(e, "trial"))
    zero = F.struct(F.lit(0).cast("long").alias("key"), F.try_element_at("trials", F.lit(0).cast("long")).alias("value"))
    ways = F.when(F.col("direct"), direct).when(~F.col("unmatched") & stem.isNotNull(), F.concat(F.coalesce(by_map, F.array().cast(rows.select(direct.alias("d")).schema["d"].dataType)), F.array(mapped(zero, "default"))))
    tried = rows.select("folder", "tag", "key", "unmatched", F.explode_outer(ways).alias("w")).select("folder", "tag", "key", "unmatched", "w.*")
    ok = tried.join(valid.withColumn("valid", F.lit(True)), "epoch", "left").where(F.col("valid") | (F.col("way") == "direct"))
    best = ok.groupBy("folder", "tag", "key").agg(F.max(F.col("way") != "default").alias("explicit"))
    ok = ok.join(best, ["folder", "tag", "key"]).where(~F.col("explicit") | (F.col("way") != "default")).drop("way", "valid", "explicit", "unmatched")
    there = existing.select("folder", F.col("key").alias("target_key")).distinct().withColumn("exists", F.lit(not overwrite))
    ok = ok.join(there, ["folder", "target_key"], "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    return rows.select("folder", "tag", "key", "unmatched").join(ok, ["folder", "tag", "key"], "left")


def import_counters(targets: DataFrame) -> DataFrame:
    """The counters of `import_targets` in one row; they overlap, as one entry may have several targets: scanned, unmatched, missing_epoch and remapped
    count entries, skipped_existing, imported and missing_outputs (those imported without artefacts) count targets."""
    has, imported = F.col("epoch").isNotNull(), F.col("epoch").isNotNull() & ~F.coalesce("exists", F.lit(False))
    per = targets.groupBy("folder", "tag", "key").agg(
        F.max("unmatched").alias("unmatched"), F.max(has).alias("any"), F.coalesce(F.max("remapped"), F.lit(False)).alias("remapped"),
        F.count_if("exists").alias("existing"), F.count_if(imported).alias("imported"), F.count_if(imported & (F.col("outputs") == 0)).alias("bare"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(
        F.count("*").alias("scanned"), F.count_if("unmatched").alias("unmatched"), F.count_if(~F.col("any") & ~F.col("unmatched")).alias("missing_epoch"), F.count_if("remapped").alias("remapped"),
        total("existing").alias("skipped_existing"), total("imported").alias("imported"), total("bare").alias("missing_outputs"),
    )
