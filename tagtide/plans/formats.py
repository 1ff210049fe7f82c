"""Round trips through every reader and writer: tables written in a format and read back, held against the tables.

Files go to a new folder below the shared one. Posts are made of all events, one each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.functions import language
from tagtide.functions import vectors as vc
from tagtide.operators import tables
from tagtide.plans.catalogue import _GRAMS, _PROFILE, _t, query
from tagtide.sources import posts

DAY = "strftime(ts, '%a %b %d %H:%M:%S +0000 %Y')"
RAW_SQL = f"select {DAY} created_at, 'Post ' || event_id || ' #' || event_type text, 'User' || user_id screen_name from events"


def _flat(spark, d) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("Post "), "event_id", F.lit(" #"), "event_type").alias("text"), F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"),
        F.concat(F.lit("User"), "user_id").alias("screen_name"),
    )


def _raw_lines(spark, d) -> DataFrame:
    """Each post as a nested line, its text broken over two lines, with what a crawl holds besides: notices, comments, cut lines, blanks."""
    nested = _flat(spark, d).select("created_at", F.regexp_replace("text", "^Post ", "Post\n ").alias("text"), F.struct("screen_name").alias("user"))
    line = F.to_json(F.struct("*"))
    noise = F.array(line, F.lit('{"delete":{"status":{"id":1}}}'), F.lit("# comment"), F.lit(""), F.substring(line, 1, 40), F.lit('{"created_at":"x","text":null,"user":{"screen_name":"y"}}'))
    return nested.select(F.explode(noise).alias("value"))


def _crawl(spark, d, codec: str, ending: str) -> str:
    folder = posts.work_folder(spark, "crawl")
    for part in (0, 1):  # two levels of folders
        _raw_lines(spark, d).filter(F.pmod(F.xxhash64("value"), F.lit(2)) == part).write.option("compression", codec).text(f"{folder}/{'deep/' * part}{ending}")
    return folder


def _read_raw(spark, folder) -> DataFrame:
    return posts.raw_posts(spark, folder).select("created_at", "text", "screen_name")


@query("read_gzip_posts", RAW_SQL)
def read_gzip_posts(spark, d):
    return _read_raw(spark, _crawl(spark, d, "gzip", "gz"))


@query("read_bzip2_posts", RAW_SQL)
def read_bzip2_posts(spark, d):
    return _read_raw(spark, _crawl(spark, d, "bzip2", "bz2"))


@query("source_files", "select true compressed, true hidden_skipped, count(*) n from events")
def source_files(spark, d):
    """Every row names its file; hidden files aren't read."""
    folder = _crawl(spark, d, "gzip", "gz")
    _raw_lines(spark, d).write.option("compression", "gzip").text(f"{folder}/_hidden")
    return posts.raw_posts(spark, folder).agg(F.bool_and(F.col("file").endswith(".gz")).alias("compressed"), (F.count_if(F.col("file").startswith("_")) == 0).alias("hidden_skipped"), F.count(F.lit(1)).alias("n"))


@query("normalised_posts", f"with p as ({RAW_SQL}) select created_at, lower(text) text, lower(screen_name) screen_name from p")
def normalised_posts(spark, d):
    return posts.normalised(read_gzip_posts(spark, d))


@query("json_lines", f"select event_id id, 'Post ' || event_id || ' #' || event_type text, {DAY} created_at, 'User' || user_id screen_name from events")
def json_lines(spark, d):
    folder = posts.work_folder(spark, "json")
    posts.write_json_lines(_flat(spark, d), folder)
    return posts.flat_posts(spark, folder).drop("file")


@query("json_escapes", """select doc_id, replace(to_json(struct_pack(doc_id, text, ratio := null::DOUBLE))::VARCHAR, '/', '\\/') line from (select doc_id, replace(lang || '/' || coalesce(source, ''), '"', '') || chr(10) || n_chars text from documents where doc_id % 2 = 0)
union all select doc_id, '{"doc_id":' || doc_id || ',"text":"\\u2028\\u0085' || n_chars || '","ratio":null}' from documents where doc_id % 2 = 1""")
def json_escapes(spark, d):
    """Slashes, line separators and controls are escaped; NaN is null."""
    docs = _t(spark, d, "documents")
    plain = F.concat(F.replace(F.concat("lang", F.lit("/"), F.coalesce("source", F.lit(""))), F.lit('"'), F.lit("")), F.lit("\n"), "n_chars")
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, plain).otherwise(F.concat(F.lit("\u2028\u0085"), "n_chars")).alias("text"), F.lit(float("nan")).alias("ratio"))
    return posts.to_json_lines(rows, True).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.col("value").alias("line"))


@query("parquet_files", "select o_orderkey, o_orderstatus, o_totalprice, o_orderdate from orders")
def parquet_files(spark, d):
    """Overwritten once, partitioned."""
    folder, rows = posts.work_folder(spark, "parquet"), _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    posts.write_parquet(rows.limit(5), folder)
    posts.write_parquet(rows, folder, ["o_orderstatus"])
    return spark.read.parquet(folder).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query("csv_files", "select c_custkey, c_name, c_acctbal from customer")
def csv_files(spark, d):
    folder, rows = posts.work_folder(spark, "csv"), _t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    posts.write_csv(rows, folder)
    return spark.read.schema(rows.schema).option("header", True).csv(folder)


@query("tsv_files", "select c_custkey, c_name, c_acctbal from customer")
def tsv_files(spark, d):
    folder, rows = posts.work_folder(spark, "tsv"), _t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    posts.write_tsv(rows, folder)
    return posts.read_tsv(spark, folder, rows.schema.simpleString()[7:-1].replace(":", " "))


@query("tsv_to_csv_files", "select c_custkey::VARCHAR c_custkey, c_name, case when c_custkey % 3 <> 0 then c_acctbal::VARCHAR end c_acctbal from customer")
def tsv_to_csv_files(spark, d):
    """Cells trimmed; NaN becomes an empty cell."""
    source, target = posts.work_folder(spark, "from"), posts.work_folder(spark, "to")
    rows = _t(spark, d, "customer").select(F.concat(F.lit(" "), "c_custkey").alias("c_custkey"), F.concat("c_name", F.lit(" ")).alias("c_name"), F.when(F.col("c_custkey") % 3 == 0, "NaN").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"))
    rows.write.option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(source)
    posts.tsv_to_csv(spark, source, target)
    return spark.read.option("header", True).csv(target)


@query("single_text_file", "select r_regionkey || ',' || r_name line, 1::BIGINT files from region")
def single_text_file(spark, d):
    folder = posts.work_folder(spark, "text")
    posts.write_single_text(_t(spark, d, "region").select("r_regionkey", "r_name"), folder)
    lines = spark.read.text(folder).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))
    return lines.join(F.broadcast(lines.agg(F.count_distinct("file").alias("files")))).select("line", "files")


@query("merged_iterations", "select event_id % 3 iteration, event_type hashtag, count(*) n, row_number() over (order by event_id % 3, event_type) - 1 place from events group by 1, 2")
def merged_iterations(spark, d):
    """A result folder per iteration, merged in order."""
    counts = _t(spark, d, "events").groupBy((F.col("event_id") % 3).alias("iteration"), F.col("event_type").alias("hashtag")).agg(F.count(F.lit(1)).alias("n"))
    folders = [f"{posts.work_folder(spark, 'iteration')}" for _ in range(3)]
    for i, folder in enumerate(folders):
        counts.filter(F.col("iteration") == i).write.csv(folder)
    merged = posts.merge_iterations(spark, folders, "iteration long, hashtag string, n long")
    return posts.sequential_ids(merged, ["iteration", "hashtag"], 0, "place").select("iteration", "hashtag", "n", "place")


@query("feature_file", """select o_orderkey row_id, (o_orderkey % 2)::DOUBLE "label", f.i feature_id, f.v "value", case when f.i < 3 then 'term' when f.i < 5 then 'hashtag' when f.i < 6 then 'mention' when f.i < 8 then 'user' else 'location' end family
from orders, (select unnest([0, 4, 7, 9]) i, unnest([1.0::DOUBLE, 2.5, 1.0, 3.0]) v) f where not (f.i = 4 and o_orderkey % 3 = 0)""")
def feature_file(spark, d):
    """Sparse rows with a header that tells families; values near zero are none."""
    folder = posts.work_folder(spark, "features")
    head = spark.createDataFrame([("# features",), ("rows=1, columns=10, term=3, hashtag=2, mention=1, user=2, location=2",)], "value string")
    small = F.when(F.col("o_orderkey") % 3 == 0, "1e-13").otherwise("2.5")
    rows = _t(spark, d, "orders").select(F.concat("o_orderkey", F.lit(" ([0,4,7,9],[1.0,"), small, F.lit(",1.0,3.0]) "), F.col("o_orderkey") % 2).alias("value"))
    head.unionByName(rows).write.text(folder)
    return posts.read_features(spark, folder)[0]


@query("profile_file", f"with {_GRAMS}, {_PROFILE} select ngram, cnt from pf")
def profile_file(spark, d):
    """The profile of English, saved and loaded."""
    folder = posts.work_folder(spark, "profile")
    language.save_profile(language.profile(_t(spark, d, "documents").filter("lang = 'en'")), folder)
    return language.load_profile(spark, folder)


@query("english_posts", f"with {_GRAMS}, {_PROFILE}, m as (select doc_id, count(*) total, count(pf.ngram) matched from (select distinct doc_id, ngram from gg) left join pf using (ngram) group by 1) select doc_id id from m where 1 - matched / total < 0.4")
def english_posts(spark, d):
    """Documents in English, by trigrams."""
    docs = _t(spark, d, "documents")
    return language.english_only(docs.select(F.col("doc_id").alias("id"), "text"), language.profile(docs.filter("lang = 'en'")), "id").select("id")


@query("post_tables", "select 'user' || user_id u, event_type h, min(epoch_us(ts) // 1000000 * 1000000) birthday, count(*) nbr_tweets from events group by all")
def post_tables(spark, d):
    """From files to first uses: read, numbered, tags extracted, aggregated."""
    folder = posts.work_folder(spark, "flat")
    posts.write_json_lines(_flat(spark, d), folder, "gzip")
    return tables.birthdays(tables.post_uses(posts.flat_posts(spark, folder)), ["u", "h"])


SPARSE = "with v as (select vec_id, list_transform(embedding::DOUBLE[], lambda x: case when abs(x) >= 0.1 then x else 0 end) a from embeddings), p as (select x.vec_id, x.a, y.a b from v x join v y on y.vec_id = x.vec_id + 1)"
_D = "list_transform(range(1, len(a) + 1), lambda i: a[i] - b[i])"


@query("sparse_vectors", f"""{SPARSE} select vec_id, round(list_sum(list_transform({_D}, lambda x: abs(x))), 9) l1, round(sqrt(list_sum(list_transform({_D}, lambda x: x * x))), 9) l2, list_max(list_transform({_D}, lambda x: abs(x))) linf,
  round(list_sum(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i])), 9) dot, round(list_sum(list_transform(a, lambda x: x)) / sqrt(list_sum(list_transform(a, lambda x: x * x))), 9) unit_sum, len(list_filter(a, lambda x: x <> 0)) / len(a) sparsity,
  len(list_filter(range(1, len(a) + 1), lambda i: a[i] + b[i] <> 0)) nnz_sum, len(list_filter(a[3:10], lambda x: x <> 0)) nnz_part, len(list_filter(a, lambda x: x <> 0)) + len(list_filter(b, lambda x: x <> 0)) nnz_both, len(list_filter(a, lambda x: x + 1 <> 0)) nnz_plus,
  round(coalesce(list_sum(list_transform(list_filter(range(1, len(a) + 1), lambda i: b[i] <> 0), lambda i: a[i] / b[i])), 0), 6) ratios, a = b same from p""")
def sparse_vectors(spark, d):
    """Embeddings with values below 0.1 as zeros, each with its successor."""
    dense = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    entries = F.filter(F.transform("e", lambda x, i: F.struct(i.alias("key"), x.alias("value"))), lambda s: F.abs(s["value"]) >= 0.1)
    v = dense.select("vec_id", F.map_from_entries(entries).alias("a"), F.size("e").alias("n"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    total = lambda m: F.aggregate(F.transform(F.array_sort(F.map_entries(m)), lambda e: e["value"]), F.lit(0.0), lambda s, x: s + x)
    size = lambda m: F.size(m).cast("long")
    return pairs.select(
        "vec_id", F.round(vc.l1(a, b), 9).alias("l1"), F.round(vc.l2(a, b), 9).alias("l2"), vc.l_infinity(a, b).alias("linf"), F.round(vc.dot(a, b), 9).alias("dot"), F.round(total(vc.unit(a)), 9).alias("unit_sum"), vc.sparsity(a, n).alias("sparsity"),
        size(vc.add(a, b)).alias("nnz_sum"), size(vc.subvector(a, 2, 8)).alias("nnz_part"), size(vc.append(a, n, b)).alias("nnz_both"), size(vc.map_add(a, n, 1.0)).alias("nnz_plus"), F.round(total(vc.divide(a, b)), 6).alias("ratios"), vc.equal(a, b).alias("same"),
    )
