"""Command line: python -m typeloom.cli {classify,discover,llm,evaluate,extract,check} ..."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import text
from .operators import clustering, dimensions, encoders, entities, evaluation, features, gateway, hybrid, ranking, readers
from .sources import providers, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="typeloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def table(name: str, what: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name, help=what)
        s.add_argument("--input", required=True, help="records: a delimited file or workbook")
        s.add_argument("--out", required=True, help="folder for results")
        s.add_argument("--key", default="pn", help="column of the part number")
        s.add_argument("--description", default="description", help="columns of descriptions, by comma")
        s.add_argument("--label", default=None, help="column of expert labels")
        s.add_argument("--limit", type=int, help="the first so many parts")
        s.add_argument("--rows", type=int, help="the first so many records")
        s.add_argument("--overrides", help="YAML file of expert assignments")
        s.add_argument("--encoder", default="tfidf")
        s.add_argument("--latest", help="folder that always holds the last document")
        return s

    c = table("classify", "learn from labelled parts, assign the others, discover new types")
    c.add_argument("--folds", type=int, default=5)
    c.add_argument("--target", type=float, default=0.999, help="accuracy that accepted answers must reach")
    c.add_argument("--threshold", type=float, help="a fixed margin instead")
    c.add_argument("--discovery", type=float, default=0.60, help="distance below which declined parts join")
    c.add_argument("--naming", choices=["ctfidf", "llm", "none"], default="ctfidf")
    c.add_argument("--simulate", type=float, help="hide this share of classes and report how they fare")
    c.add_argument("--extra", help="a second labelled file")
    c.add_argument("--model", help="folder of the model")
    c.add_argument("--predict-only", action="store_true", help="use the saved model")
    c.add_argument("--compare", action="store_true", help="also cluster without labels and report both")
    c.add_argument("--override", action="append", default=[], metavar="PN=NAME", help="write a correction and stop")
    d = table("discover", "types without labels")
    d.add_argument("--types", type=int, help="number of types instead of a distance")
    d.add_argument("--distance", type=float, default=0.75)
    d.add_argument("--grouping", choices=["local", "llm"], default="local")
    a = table("llm", "taxonomy and classification by a language model")
    a.add_argument("--config")
    a.add_argument("--taxonomy", choices=["discover", "seed", "fixed"])
    a.add_argument("--cache", help="folder of answers")
    a.add_argument("--no-cache", action="store_true")
    a.add_argument("--no-new", action="store_true", help="only names of the taxonomy")
    a.add_argument("--no-eval", action="store_true")
    e = sub.add_parser("evaluate", help="judge clusters against labels")
    e.add_argument("rows")
    e.add_argument("--label", default="label")
    e.add_argument("--cluster", default="cluster_name")
    x = sub.add_parser("extract", help="dimensions of parts")
    x.add_argument("--pn")
    x.add_argument("--title")
    x.add_argument("--category")
    x.add_argument("--brand", default="")
    x.add_argument("--samples", help="delimited file of known sheets: pn, title, text")
    x.add_argument("--no-fallback", action="store_true", help="no synthetic sheet for unknown parts")
    x.add_argument("--pages", help="Parquet table of pages (url, title, html) that is searched before the samples")
    x.add_argument("--cache", help="folder of sheets found before")
    x.add_argument("--refresh", action="store_true", help="ask again for what the cache holds")
    x.add_argument("--csv-in")
    x.add_argument("--csv-out")
    x.add_argument("--limit", type=int)
    x.add_argument("--json", action="store_true")
    sub.add_parser("check", help="is everything needed installed?")
    return p


def read_parts(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """Records with stable row ids, and one row a part with its description, phrase and label."""
    raw = tables.read_workbook(spark, a.input) if a.input.lower().endswith(".xlsx") else tables.read_records(spark, a.input)
    wanted = [a.key, *a.description.split(",")]
    if missing := tables.missing_columns(raw, wanted[:2]):
        raise SystemExit(f"columns missing in {a.input}: {', '.join(missing)}")
    raw = entities.ensure_columns(raw, wanted)
    cols = [F.col(c) for c in a.description.split(",")]
    matdesc = text.build_description(cols[0], cols[1]) if len(cols) > 1 else text.clean_str(cols[0])
    label = F.trim(a.label) if a.label else F.lit(None).cast("string")
    records = tables.stored(raw.select("*", F.monotonically_increasing_id().alias("row_id"), F.trim(a.key).alias("_pn"), matdesc.alias("_matdesc"), label.alias("_label")))
    if a.rows:
        records = ranking.head(records, "row_id", a.rows)
    parts = entities.dedup_to_parts(records, "_pn", "_matdesc", {}).withColumnsRenamed({"_pn": "pn", "MATDESC": "matdesc"})
    parts = parts.join(entities.label_mode(records.select(F.col("_pn").alias("pn"), "_label"), "pn", "_label"), "pn")
    parts = parts.withColumn("phrase", text.type_phrase(F.col("matdesc"))).withColumn("readable", text.readable_description(F.col("matdesc"), F.col("pn")))
    return records, tables.stored(ranking.head(parts, "pn", a.limit) if a.limit else parts)


def finish(spark: SparkSession, a: argparse.Namespace, records: DataFrame, out: DataFrame, metrics: dict) -> None:
    """Result per part and per record, a legend, and a document for a panel."""
    out = tables.stored(out)
    legend = ranking.cluster_letters(out, "cluster_name")
    tables.write_csv(out, f"{a.out}/parts")
    tables.write_csv(entities.spread_to_records(records.drop("pn", "_matdesc").withColumnRenamed("_pn", "pn"), out, "pn", "cluster_name"), f"{a.out}/records")
    tables.write_csv(legend, f"{a.out}/legend", single=True)
    stamp = datetime.now(timezone.utc).isoformat(timespec="seconds")
    document = tables.result_document(out, legend, metrics, stamp)
    for folder in [f"{a.out}/document", *([a.latest] if a.latest else [])]:
        document.write.mode("overwrite").json(folder)
    print(json.dumps(metrics))


def measured(out: DataFrame, label: str = "label", cluster: str = "cluster_name") -> dict:
    table = tables.stored(evaluation.contingency(out.filter(~text.is_unlabelled(F.col(label))), label, cluster))
    if table.isEmpty():
        return {}
    return {**evaluation.pair_metrics(table).first().asDict(), **evaluation.entropy_metrics(table).first().asDict(), **evaluation.matching_accuracy(out.sparkSession, table).first().asDict()}


def run_classify(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.override:
        new = spark.createDataFrame([tuple(x.split("=", 1)) for x in a.override], "pn string, cluster string")
        done = entities.upsert_overrides(tables.read_overrides(spark, a.overrides), new)
        body = tables.overrides_yaml(done)
        with open(a.overrides, "w", encoding="utf-8") as f:
            f.write(body)
        print(f"{len(body.splitlines())} assignments")
        return
    records, parts = read_parts(spark, a)
    fixed = tables.read_overrides(spark, a.overrides) if a.overrides else None
    if a.extra:
        b = argparse.Namespace(**{**vars(a), "input": a.extra, "limit": None, "rows": None})
        parts = tables.stored(entities.labelled_union(parts, read_parts(spark, b)[1].filter("label != 'tbd'"), "pn"))
    # A saved model brings the space that its weights belong to.
    encode = encoders.load(spark, f"{a.model}/encoder") if a.predict_only else encoders.fitted(a.encoder, parts, "pn", "matdesc")
    parts = tables.stored(parts.join(encode(parts, "pn", "matdesc"), "pn"))
    known = parts.filter(~text.is_unlabelled(F.col("label"), "equals"))
    settings = hybrid.Settings(target=a.target, threshold=a.threshold, discovery=a.discovery, folds=a.folds, head=a.encoder.endswith("+head"))
    model = hybrid.HybridClassifier.load(spark, a.model) if a.predict_only else hybrid.HybridClassifier(settings).fit(known, "pn", "features", "label", fixed)
    metrics = {} if a.predict_only else {**model.report.first().asDict(), "threshold": model.threshold}
    if a.model and not a.predict_only:
        model.save(spark, a.model)
        encoders.save(encode, a.encoder, spark, f"{a.model}/encoder")
    if a.simulate:
        metrics |= hybrid.simulate_new_types(known, "pn", "features", "label", a.simulate, settings).first().asDict()
    if a.compare:
        plain = clustering.cluster(known, "pn", "features", a.discovery).join(known.select("pn", "label"), "pn")
        metrics |= {f"unsupervised_{k}": v for k, v in measured(plain, cluster="cluster").items()}
    out = tables.stored(model.predict(parts, "pn", "features", fixed).drop("features"))
    new = out.filter(F.col("cluster_name").startswith("NEW_"))
    if a.naming != "none" and not new.isEmpty():
        names = features.group_names(new, "cluster_name", "matdesc")
        if a.naming == "llm":
            groups = {r[0]: r[1] for r in new.groupBy("cluster_name").agg(F.slice(F.sort_array(F.collect_set("readable")), 1, 5)).collect()}
            got = gateway.name_groups(groups, gateway.KeywordModel(), {r[0]: r[1] for r in names.collect()})
            names = spark.createDataFrame(list(got.items()), "cluster_name string, name string")
        named = ranking.tell_apart(names.join(new.groupBy("cluster_name").agg(F.count("*").alias("n")), "cluster_name"), "cluster_name", "name", "n")
        out = entities.lookup(out, named, "cluster_name", "unique_name", "cluster_name", F.col("cluster_name"))
    finish(spark, a, records, out, metrics)


def run_discover(spark: SparkSession, a: argparse.Namespace) -> None:
    records, parts = read_parts(spark, a)
    vectors = encoders.encoder(a.encoder)(parts, "pn", "phrase")
    parts = tables.stored(parts.join(vectors, "pn"))
    known = None
    if a.grouping == "llm":
        phrases = [r[0] for r in parts.groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").select("phrase").collect()]
        known = spark.createDataFrame(list(gateway.group_phrases(phrases, gateway.KeywordModel()).items()), "phrase string, `group` string")
    elif a.types:
        mean = features.centroids(parts, "phrase", "features")
        grouped = clustering.cluster_small(mean, "phrase", "centroid", k=a.types)
        known = grouped.join(clustering.shortest_name(grouped, "cluster", "phrase"), "cluster").select("phrase", F.col("name").alias("group"))
    fixed = tables.read_overrides(spark, a.overrides) if a.overrides else None
    out = clustering.discover_types(parts, "pn", "phrase", "features", a.distance, known, fixed)
    out = tables.stored(out.withColumnRenamed("type_group", "cluster_name").drop("features"))
    finish(spark, a, records, out, measured(out) if a.label else {})


def run_llm(spark: SparkSession, a: argparse.Namespace) -> None:
    records, parts = read_parts(spark, a)
    settings = config.load(a.config)
    model = gateway.Retrying(gateway.KeywordModel(), settings["llm"]["retries"])
    cards = parts.select("pn", text.part_card({"desc": F.col("matdesc")}, ("desc",)).alias("card"))
    seed = [r[0] for r in entities.label_list(parts, "label").orderBy("label").collect()] if a.label else []
    names = gateway.taxonomy(a.taxonomy or settings["taxonomy"]["mode"], seed, lambda: gateway.discover_taxonomy(cards, "pn", "card", model, settings["taxonomy"]["sample"]))
    empty = spark.createDataFrame([], "pn string, cluster string")
    cache = tables.read_cache(spark, a.cache, "pn string, cluster string") if a.cache and not a.no_cache else empty
    got = tables.stored(gateway.classify_missing(cards, cache, "pn", "card", model, size=settings["llm"]["batch_size"], allow_new=not a.no_new))
    if a.no_new:
        got = got.withColumn("cluster", F.when(F.upper("cluster").isin(names), F.col("cluster")).otherwise(gateway.UNANSWERED))
    if a.cache and not a.no_cache:
        fresh = entities.keep_missing(got, cache, "pn")
        tables.append_cache(fresh.withColumn("cluster", F.when(F.col("cluster") != gateway.UNANSWERED, F.col("cluster"))), a.cache, "pn", "cluster")
    out = parts.join(got.select("pn", F.col("cluster").alias("cluster_name")), "pn")
    finish(spark, a, records, out, {} if a.no_eval or not a.label else measured(out))


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = tables.read_records(spark, a.rows, ";", "utf-8-sig").filter(~text.is_unlabelled(F.col(a.label)))
    print(json.dumps(measured(rows, a.label, a.cluster)))
    for r in evaluation.worst_classes(evaluation.purity_map(evaluation.contingency(rows, a.label, a.cluster))).collect():
        print(f"{r.y}: {r.n} rows in {r.n_clusters} clusters, purity {r.purity:.3f}; {r.distribution}")


def run_extract(spark: SparkSession, a: argparse.Namespace) -> None:
    kinds = "pn string, title string, category string"
    known = tables.read_records(spark, a.samples).select("pn", "title", "text") if a.samples else spark.createDataFrame([], "pn string, title string, text string")
    if a.csv_in:
        items = tables.read_records(spark, a.csv_in)
        found = dimensions.find_columns(items.columns)
        if not found["pn"]:
            raise SystemExit(f"no part number column in {a.csv_in}")
        items = items.withColumn("row_id", F.monotonically_increasing_id())
        items = ranking.head(items, "row_id", a.limit) if a.limit else items
        pick = lambda k: F.col(found[k]) if found[k] else F.lit(None).cast("string")
        queries = items.select(pick("pn").alias("pn"), pick("title").alias("title"), pick("category").alias("category")).dropDuplicates(["pn"])
    else:
        queries = spark.createDataFrame([(a.pn, a.title, a.category)], kinds)
    sources = [providers.PageTable(spark.read.parquet(a.pages))] if a.pages else []
    if a.cache:
        sources = [providers.Cached(p, f"{a.cache}/{i}", refresh=a.refresh) for i, p in enumerate(sources)]
    queries = tables.stored(queries)
    out = readers.process(queries, providers.cascade([*sources, providers.Samples(known, not a.no_fallback)], queries))
    if a.csv_in:
        flat = out.select(F.col("pn").alias("_pn"), "method", "confidence", "metric.*")
        tables.write_csv(items.join(flat, items[found["pn"]] == flat["_pn"], "left").orderBy("row_id").drop("_pn", "row_id"), a.csv_out, single=True)
    else:
        r = out.select(F.to_json(F.struct("*"))).first()
        print(r[0] if a.json else json.dumps(json.loads(r[0]), indent=2, ensure_ascii=False))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "check":
        rows, fine = config.check_environment()
        for name, version, needed in rows:
            print(f"{'ok' if version else 'missing' if needed else 'optional'}: {name} {version}")
        return 0 if fine else 1
    spark = SparkSession.builder.appName("typeloom").getOrCreate()
    {"classify": run_classify, "discover": run_discover, "llm": run_llm, "evaluate": run_evaluate, "extract": run_extract}[a.command](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
