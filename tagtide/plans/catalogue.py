"""The operators over the driver's tables, each with the SQL that DuckDB runs on the same tables.

Posts are `events`: the user is user_id, the tag is the event type with the tens of props.k, and a post mentions
user k. Sizes are parameters of the catalogue, not limits of the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagtide.functions import entities, language
from tagtide.functions import scalars as sc
from tagtide.operators import groups, information, lag, metrics, sampling, statistics, tables
from tagtide.sources.posts import kept

N_ITER, SIZE, SEED = 3, 20, 42
MAX = sc.MAX_LAG_MS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TH = "th as (select event_id tid, user_id u, event_type || '_' || ((props->>'$.k')::INT // 10) h, epoch_us(ts) us from events)"
MN = "mn as (select user_id src, (props->>'$.k')::BIGINT dst from events where user_id <> (props->>'$.k')::BIGINT)"
NET = f"{MN}, net as (select src, dst, count(*) weight from mn group by all)"
PU = f"{TH}, pu as (select u, h, min(us) birthday, count(*) nbr_tweets from th group by all)"
GB = f"{PU}, gb as (select h, min(us) birthday from th group by all)"
US = f"""{GB}, {NET}, us as (select u, count(distinct tid) nbr_tweets, count(distinct h) nbr_hashtags, coalesce(any_value(m), 0) nbr_mentions
  from th left join (select src, count(distinct dst) m from mn group by 1) on src = u group by u)"""
IT = f"it as (select unnest(range(0, {N_ITER})) iteration)"
GA = f"{US}, {IT}, ga as (select iteration, u from (select iteration, u, row_number() over (partition by iteration order by md5('{SEED}:' || iteration || ':' || u), u) r from us, it where nbr_mentions >= 1) where r <= {SIZE})"
B1 = f"{GA}, b1 as (select iteration, u, sensor from (select iteration, ga.u, dst sensor, row_number() over (partition by iteration, ga.u order by md5('{SEED}:' || iteration || ':' || ga.u || ':' || dst), dst) r from ga join (select distinct src, dst from net) n on n.src = ga.u) where r = 1)"
SCORE = f"{GB}, sc as (select x.u, round(avg(coalesce((pu.birthday - x.birthday) // 1000, 11100000000)))::BIGINT lagtime from (select u, h, birthday from (select distinct u from th), gb) x left join pu on pu.u = x.u and pu.h = x.h group by x.u)"
DOCS = "docs as (select d.doc_id, lang, source, n_chars, text, toxic, quality from documents d join labels l using (doc_id))"
WORDS = f"{DOCS}, wf as (select distinct doc_id \"row\", lower(lang) family, unnest(regexp_extract_all(lower(text), '[a-z]+')) feature from docs), lb as (select doc_id \"row\", toxic \"label\" from docs)"
RANKED = f"{DOCS}, sc as (select doc_id id, lang topic, toxic \"label\", n_chars score from docs)"


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _uses(spark, d):
    return tables.event_uses(_t(spark, d, "events"))


def _mentions(spark, d):
    return tables.event_mentions(_t(spark, d, "events"))


def _network(spark, d):
    return tables.mention_network(_mentions(spark, d))


def _per_user(spark, d):
    return tables.birthdays(_uses(spark, d), ["u", "h"])


def _births(spark, d):
    return _uses(spark, d).groupBy("h").agg(F.min("us").alias("birthday"))


def _users(spark, d):
    return tables.users(_uses(spark, d), _mentions(spark, d))


def _control(spark, d):
    return groups.control_groups(spark, _users(spark, d), N_ITER, SIZE, SEED, min_mentions=1)


def _labelled(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")


def _ranking(spark, d):
    return _labelled(spark, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("topic"), F.col("toxic").alias("label"), F.col("n_chars").alias("score"))


def _word_features(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return _labelled(spark, d).select(F.col("doc_id").alias("row"), F.col("toxic").alias("label"), F.lower("lang").alias("family"), F.explode(words).alias("feature"))


def _row_labels(spark, d):
    return _labelled(spark, d).select(F.col("doc_id").alias("row"), F.col("toxic").alias("label"))


def _r(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- flagship and lag times


@query("lag_group_a", f"with {GB}, g as (select distinct u from th order by md5('{SEED}:' || u), u limit 5), f as (select h, min(birthday) b from pu join g using (u) group by h) select gb.h, coalesce((f.b - gb.birthday) // 1000, {MAX}) lag from gb left join f using (h)")
def lag_group_a(spark, d):
    uses = _uses(spark, d)
    group = sampling.exactly(uses.select("u").distinct(), 5, SEED, "u").select(F.lit(0).alias("iteration"), F.lit("A").alias("group"), "u")
    first = lag.first_uses(group, tables.birthdays(uses, ["u", "h"]))
    return lag.lag_times(first, lag.targets(tables.birthdays(uses, ["h"])), group).select("h", "lag")


@query("lag_single_user", f"with {GB}, g as (select distinct u from th order by md5('{SEED}:' || u), u limit 1), f as (select h, min(birthday) b from pu join g using (u) group by h) select gb.h, coalesce((f.b - gb.birthday) // 1000, {MAX}) lag from gb left join f using (h)")
def lag_single_user(spark, d):
    uses = _uses(spark, d)
    group = sampling.exactly(uses.select("u").distinct(), 1, SEED, "u").select(F.lit(0).alias("iteration"), F.lit("A").alias("group"), "u")
    return lag.lag_times(lag.first_uses(group, tables.birthdays(uses, ["u", "h"])), lag.targets(tables.birthdays(uses, ["h"])), group).select("h", "lag")


MEMBERS = f"{B1}, mem as (select iteration, 'A' g, u from ga union all select iteration, 'B' g, sensor u from b1)"
FIRST = f"{MEMBERS}, fu as (select iteration, g, h, min(birthday) f, sum(nbr_tweets)::BIGINT total from (select distinct * from mem) join pu using (u) group by all)"


def _user_groups(spark, d):
    """Membership: a few rows per iteration and group that many branches of a plan use, so they are kept."""
    control = kept(_control(spark, d))
    b1 = groups.sensors(control, _network(spark, d), SEED)
    return kept(control.select("iteration", F.lit("A").alias("group"), "u").unionByName(b1.select("iteration", F.lit("B").alias("group"), F.col("sensor").alias("u"))).distinct())


NM = f"{MEMBERS}, nm as (select iteration, g, count(*)::BIGINT n from (select distinct * from mem) join th using (u) group by all)"
POSTS = f"""{NM}, cp as (select iteration, tid from (select iteration, tid, n, row_number() over (partition by iteration order by md5('C:' || iteration || ':' || tid), tid) r from th, (select iteration, n from nm where g = 'B')) where r <= n),
bp as (select distinct iteration, tid from mem join th using (u) where g = 'B'),
dp as (select iteration, tid from (select iteration, tid, n, row_number() over (partition by iteration order by md5('D:' || iteration || ':' || tid), tid) r from bp join (select iteration, n from nm where g = 'A') using (iteration)) where r <= n)"""


def _post_groups(spark, d, members=None):
    uses, members = _uses(spark, d), _user_groups(spark, d) if members is None else members
    sizes = kept(members.join(uses.select("u", "tid"), "u").groupBy("iteration", "group").agg(F.count(F.lit(1)).alias("n")))
    c = groups.sampled_posts(uses, sizes.filter("group = 'B'").select("iteration", "n"), "C")
    b_posts = members.filter("group = 'B'").join(uses.select("u", "tid"), "u").select("iteration", "tid").distinct()
    dd = groups.sampled_posts(b_posts, sizes.filter("group = 'A'").select("iteration", "n"), "D")
    return c.select("iteration", F.lit("C").alias("group"), "tid").unionByName(dd.select("iteration", F.lit("D").alias("group"), "tid"))


@query("groups_cd", f"with {POSTS} select 'C' \"group\", * from cp union all select 'D', * from dp")
def groups_cd(spark, d):
    return _post_groups(spark, d)


C20 = f"""{NM}, heavy as (select tid from th join us using (u) where nbr_hashtags >= 20),
c20 as (select iteration, tid from (select iteration, tid, n, row_number() over (partition by iteration order by md5('C20:' || iteration || ':' || tid), tid) r from heavy, (select iteration, n from nm where g = 'B')) where r <= n),
cb as (select iteration, tid from (select iteration, tid, n, row_number() over (partition by iteration order by md5('C_bis:' || iteration || ':' || tid), tid) r from th, (select iteration, n from nm where g = 'A')) where r <= n)"""


@query("groups_cbis_c20", f"with {C20} select 'C20' \"group\", * from c20 union all select 'C_bis', * from cb")
def groups_cbis_c20(spark, d):
    """As many posts as another group wrote, of all users, or of those with twenty tags at least."""
    uses, members = _uses(spark, d), _user_groups(spark, d)
    sizes = kept(members.join(uses.select("u", "tid"), "u").groupBy("iteration", "group").agg(F.count(F.lit(1)).alias("n")))
    heavy = uses.join(_users(spark, d).filter("nbr_hashtags >= 20").select("u"), "u", "left_semi")
    c20 = groups.sampled_posts(heavy, sizes.filter("group = 'B'").select("iteration", "n"), "C20")
    c_bis = groups.sampled_posts(uses, sizes.filter("group = 'A'").select("iteration", "n"), "C_bis")
    return c20.select(F.lit("C20").alias("group"), "iteration", "tid").unionByName(c_bis.select(F.lit("C_bis").alias("group"), "iteration", "tid"))


@query("group_sizes", f"with {NM} select iteration, g \"group\", n from nm")
def group_sizes(spark, d):
    return _user_groups(spark, d).join(_uses(spark, d).select("u", "tid"), "u").groupBy("iteration", "group").agg(F.count(F.lit(1)).alias("n"))


def _efg(spark, d, members=None):
    """E, F and G: as many posts as group B wrote in the iteration, of the users with the least lag, the most tags, the most posts."""
    uses, users, members = _uses(spark, d), _users(spark, d), _user_groups(spark, d) if members is None else members
    scores = lag.user_scores(users, _births(spark, d), _per_user(spark, d))
    tops = {"E": groups.top_users(scores, "lagtime", SIZE, False), "F": groups.top_users(users, "nbr_hashtags", SIZE), "G": groups.top_users(users, "nbr_tweets", SIZE)}
    sizes = members.filter("group = 'B'").join(uses.select("u", "tid"), "u").groupBy("iteration").agg(F.count(F.lit(1)).alias("n"))
    return groups.top_user_posts(uses, tops, kept(sizes), SEED)


def _lags(spark, d):
    members, uses = _user_groups(spark, d), kept(_uses(spark, d))
    posts = _post_groups(spark, d, members).unionByName(_efg(spark, d, members))
    first = lag.first_uses(members, tables.birthdays(uses, ["u", "h"])).unionByName(lag.first_uses_of_posts(posts, uses))
    names = spark.createDataFrame([(i, g) for i in range(N_ITER) for g in "ABCDEFG"], "iteration long, group string")
    return lag.lag_times(first, _births(spark, d), names)


TOP_USERS = f"tops as (select 'E' g, u from (select u from sc order by lagtime, u limit {SIZE}) union all select 'F', u from (select u from us order by nbr_hashtags desc, u limit {SIZE}) union all select 'G', u from (select u from us order by nbr_tweets desc, u limit {SIZE}))"
EFG = f"""{POSTS}, {SCORE.split(', sc as')[1].join(['sc as', ''])}, {TOP_USERS},
ep as (select g, iteration, tid from (select t.g, nm.iteration, tid, n, row_number() over (partition by t.g, nm.iteration order by md5('{SEED}' || t.g || ':' || nm.iteration || ':' || tid), tid) r from tops t join th using (u), nm where nm.g = 'B') where r <= n)"""
CUBE = f"""{EFG}, fa as (select iteration, g, h, min(birthday) f from mem join pu using (u) group by all union all select iteration, 'C', h, min(us) from cp join th using (tid) group by all
  union all select iteration, 'D', h, min(us) from dp join th using (tid) group by all union all select iteration, g, h, min(us) from ep join th using (tid) group by all),
lg as (select iteration, g, h, coalesce((f - birthday) // 1000, {MAX}) lag from (select iteration, g, h, birthday from it, (select unnest(string_split('A,B,C,D,E,F,G', ',')) g) x, gb) x left join fa using (iteration, g, h))"""


@query("lag_cube", f"with {CUBE} select iteration, h, " + ", ".join(f"max(case when g = '{g}' then lag end) \"lag_time{g}\"" for g in "ABCDEFG") + " from lg group by all")
def lag_cube(spark, d):
    return lag.lag_cube(_lags(spark, d), list("ABCDEFG"))


@query("mean_lag", f"with {CUBE} select g \"group\", h, round(avg(lag), 6) mean_lag from lg group by all")
def mean_lag(spark, d):
    return lag.mean_over_iterations(_lags(spark, d))


@query("h_analysis", f"with {FIRST} select iteration, g \"group\", sum(total)::BIGINT before, count(*) \"after\" from fu group by all")
def h_analysis(spark, d):
    return lag.before_after(lag.first_uses(_user_groups(spark, d), _per_user(spark, d)))


@query("resume_filter", f"with {FIRST}, an as (select iteration, g, sum(total)::BIGINT before from fu group by all) select iteration, g \"group\" from an where iteration > 0 and iteration < 2")
def resume_filter(spark, d):
    done = lag.before_after(lag.first_uses(_user_groups(spark, d), _per_user(spark, d))).withColumn("h_g", F.lit(None).cast("long"))
    return lag.unfinished(done, 0, 2, "h_g").select("iteration", "group")


@query("lag_score", f"with {SCORE} select u, lagtime from sc")
def lag_score(spark, d):
    return lag.user_scores(_users(spark, d), _births(spark, d), _per_user(spark, d))


# --- tables


@query("hashtag_birthday", f"with {TH} select h, min(us) birthday, count(*) nbr_tweets from th group by h")
def hashtag_birthday(spark, d):
    return tables.birthdays(_uses(spark, d), ["h"])


@query("hashtag_birthday_per_user", f"with {PU} select * from pu")
def hashtag_birthday_per_user(spark, d):
    return _per_user(spark, d)


@query("birthday_source", f"with {TH} select h, min(us) birthday, count(*) nbr_tweets, arg_min(u, struct_pack(us, u)) source from th group by h")
def birthday_source(spark, d):
    return tables.birthday_sources(_uses(spark, d), "u")


@query("user_count", f"with {TH} select u, count(*) nbr_tweets from th group by u")
def user_count(spark, d):
    return tables.post_counts(_uses(spark, d), "u")


@query("line_count_md5", "select md5(text) digest, count(*) n from documents group by 1")
def line_count_md5(spark, d):
    return tables.line_counts(_t(spark, d, "documents"), "text")


@query("mention_network", f"with {NET} select * from net")
def mention_network(spark, d):
    return _network(spark, d)


@query("tokens", f"with {TH} select *, 1::INT one from th")
def tokens(spark, d):
    return tables.tokens(_uses(spark, d))


@query("tweets", f"with {TH} select tid, lower(trim(u::VARCHAR)) userid from th")
def tweets(spark, d):
    return _uses(spark, d).select("tid", F.lower(F.trim(F.col("u").cast("string"))).alias("userid"))


@query("users_table", f"with {US} select * from us")
def users_table(spark, d):
    return _users(spark, d)


@query("tag_splits", f"with {GB}, q as (select quantile_cont(birthday, 0.5)::BIGINT t1, quantile_cont(birthday, 0.75)::BIGINT t2 from gb) select h, birthday, case when birthday < t1 then 'train' when birthday < t2 then 'val' else 'test' end split from gb, q")
def tag_splits(spark, d):
    births = _births(spark, d)
    return tables.splits(births.join(F.broadcast(_split_times(births))), F.col("t1"), F.col("t2")).select("h", "birthday", "split")


def _split_times(births):
    q = statistics.quantiles(births, "birthday", [], [0.5, 0.75])
    return q.select(F.round(F.col("q")[0]).cast("long").alias("t1"), F.round(F.col("q")[1]).cast("long").alias("t2"))


TIMES = f"{GB}, q as (select quantile_cont(birthday, 0.5)::BIGINT t1, quantile_cont(birthday, 0.75)::BIGINT t2 from gb)"
_split = lambda us: f"case when {us} < t1 then 'train' when {us} < t2 then 'val' else 'test' end"


@query("topical_labels", f"""with {TIMES}, tp as (select h, {_split('birthday')} own from gb, q where h like 'click%'),
m as (select tid, u, us, h, {_split('us')} split from th, q), p as (select tid, u, arg_min(split, us) split, list(distinct own) filter (where own is not null) own from m left join tp using (h) group by all)
select tid, u, coalesce(list_contains(own, split), false)::INT "label", split from p where split = 'train' or not coalesce(list_contains(own, 'train'), false)""")
def topical_labels(spark, d):
    uses = _uses(spark, d)
    times = _split_times(_births(spark, d))
    topical = uses.filter(F.col("h").startswith("click")).select("h").distinct()
    return tables.labelled_posts(uses.join(F.broadcast(times)), topical, F.col("t1"), F.col("t2"))


# --- projections, filters, joins


@query("flatten_event", "select event_id, (props->>'$.k')::INT k from events")
def flatten_event(spark, d):
    return _t(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("normalise_text", "select doc_id, length(regexp_replace(text, '[\\n\\r]', '', 'g'))::INT n from documents")
def normalise_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.length(F.regexp_replace("text", r"[\n\r]", "")).alias("n"))


@query("sequential_id", "select event_id, row_number() over (order by ts, event_id) + 999 id from events")
def sequential_id(spark, d):
    from tagtide.sources.posts import sequential_ids

    return sequential_ids(_t(spark, d, "events").select("ts", "event_id"), ["ts", "event_id"], 1000).select("event_id", "id")


@query("in_list_semi", f"with {TH} select * from th where h in (select h from th group by h order by md5('{SEED}:' || h), h limit 7)")
def in_list_semi(spark, d):
    uses = _uses(spark, d)
    wanted = sampling.exactly(uses.select("h").distinct(), 7, SEED, "h")
    return uses.join(F.broadcast(wanted), "h", "left_semi").select("tid", "u", "h", "us")


@query("user_filter", f"with {US} select u from us where nbr_hashtags >= 20 and nbr_mentions >= 1")
def user_filter(spark, d):
    return _users(spark, d).filter("nbr_hashtags >= 20 and nbr_mentions >= 1").select("u")


@query("line_id_join", "with a as (select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) - 1 line from orders), b as (select c_custkey, row_number() over (order by c_custkey) - 1 line from customer) select line, o_orderkey, c_custkey from a join b using (line)")
def line_id_join(spark, d):
    """Two tables side by side, on explicit line numbers."""
    a = statistics.numbered(_t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "line")
    b = statistics.numbered(_t(spark, d, "customer").select("c_custkey"), ["c_custkey"], "line")
    return a.join(b, "line").select((F.col("line") - 1).alias("line"), "o_orderkey", "c_custkey")


@query("range_filter", "select o_orderkey from orders where o_totalprice between 1000 and 100000")
def range_filter(spark, d):
    return _t(spark, d, "orders").filter(F.col("o_totalprice").between(1000, 100000)).select("o_orderkey")


@query("arithmetic_projection", f"with {TH}, t as (select u, count(*) c from th group by u), n as (select count(*) n from th) select u, round((c - (c / n) * (c / 2.0)) / n, 9) x from t, n")
def arithmetic_projection(spark, d):
    p = _uses(spark, d)
    c, n = p.groupBy("u").agg(F.count(F.lit(1)).alias("c")), p.agg(F.count(F.lit(1)).alias("n"))
    return c.join(F.broadcast(n)).select("u", F.round((F.col("c") - F.col("c") / F.col("n") * (F.col("c") / 2.0)) / F.col("n"), 9).alias("x"))


@query("computed_lag", f"with {GB} select u, h, (pu.birthday - gb.birthday) // 1000 lag from pu join gb using (h)")
def computed_lag(spark, d):
    per, births = _per_user(spark, d), _births(spark, d).withColumnRenamed("birthday", "b")
    return per.join(births, "h").select("u", "h", F.expr("(birthday - b) div 1000").alias("lag"))


@query("drop_null", f"with {B1} select iteration, ga.u, sensor from ga left join b1 using (iteration, u) where sensor is not null")
def drop_null(spark, d):
    control = _control(spark, d)
    return control.join(groups.sensors(control, _network(spark, d), SEED), ["iteration", "u"], "left").dropna(subset=["sensor"])


@query("user_hashtag_join", f"with {GB} select distinct u, h from pu join (select h from gb where birthday > (select min(birthday) + 3600000000 from gb)) using (h)")
def user_hashtag_join(spark, d):
    births = _births(spark, d)
    late = births.join(F.broadcast(births.agg((F.min("birthday") + 3_600_000_000).alias("m"))), F.col("birthday") > F.col("m")).select("h")
    return _per_user(spark, d).join(late, "h", "left_semi").select("u", "h")


@query("hashtag_having", f"with {PU} select h, min(birthday) birthday, count(u) users from pu group by h having count(u) between 2 and 100000 and min(birthday) > 0")
def hashtag_having(spark, d):
    return _per_user(spark, d).groupBy("h").agg(F.min("birthday").alias("birthday"), F.count("u").alias("users")).filter("users between 2 and 100000 and birthday > 0")


@query("having_dups", f"with {B1} select iteration, sensor, count(*) n from b1 group by all having count(*) > 1")
def having_dups(spark, d):
    return groups.sensors(_control(spark, d), _network(spark, d), SEED).groupBy("iteration", "sensor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("keep_unique", f"with {B1} select iteration, u, sensor from b1 qualify count(*) over (partition by iteration, sensor) = 1")
def keep_unique(spark, d):
    return groups.one_to_one(groups.sensors(_control(spark, d), _network(spark, d), SEED))


@query("keep_one", f"with {TH} select h, us, u from th qualify row_number() over (partition by h order by us, u) = 1")
def keep_one(spark, d):
    return sampling.keep_one(_uses(spark, d).select("h", "us", "u"), ["h"], ["us", "u"])


@query("left_on_predicate", f"with {GB}, w as (select distinct u from th order by md5('{SEED}:' || u), u limit 5) select w.u, gb.h, pu.birthday from w cross join gb left join pu on pu.h = gb.h and pu.u = w.u")
def left_on_predicate(spark, d):
    some = sampling.exactly(_uses(spark, d).select("u").distinct(), 5, SEED, "u")
    every = _births(spark, d).select("h").join(F.broadcast(some))
    return every.join(_per_user(spark, d).select("u", "h", "birthday"), ["u", "h"], "left").select("u", "h", "birthday")


@query("three_way", f"with {PU} select th.tid, th.h, pu.birthday, n.weight from th join pu using (u, h) join (select src, sum(c) weight from (select user_id src, count(*) c from events group by 1) group by 1) n on n.src = th.u")
def three_way(spark, d):
    uses = _uses(spark, d)
    weights = uses.groupBy("u").agg(F.count(F.lit(1)).cast("decimal(38,0)").cast("long").alias("weight"))
    return uses.join(_per_user(spark, d).select("u", "h", "birthday"), ["u", "h"]).join(weights, "u").select("tid", "h", "birthday", "weight")


@query("neighbours", f"with {GA} select distinct iteration, dst u from ga join net on net.src = ga.u")
def neighbours(spark, d):
    return groups.neighbours(_control(spark, d), _network(spark, d))


NUM = f"{B1}, a as (select iteration, u, row_number() over (partition by iteration order by u) r from ga), b as (select iteration, sensor u, row_number() over (partition by iteration order by sensor) r from (select distinct iteration, sensor from b1))"


@query("zip_join", f"with {NUM} select iteration, a.r \"row\", a.u u1, b.u u2 from a join b using (iteration, r)")
def zip_join(spark, d):
    control = _control(spark, d)
    b1 = groups.sensors(control, _network(spark, d), SEED).select("iteration", F.col("sensor").alias("u")).distinct()
    return groups.positional(control, b1)


@query("cross_skeleton", f"with {GB}, {IT} select iteration, h from it, gb")
def cross_skeleton(spark, d):
    return _births(spark, d).select("h").join(F.broadcast(groups.iterations(spark, N_ITER))).select("iteration", "h")


@query("vocabulary_lookup", f"with {TH}, v as (select h, row_number() over (order by h) - 1 id from (select distinct h from th)) select v.id, h, count(*) n from th join v using (h) group by all")
def vocabulary_lookup(spark, d):
    uses = _uses(spark, d)
    words = statistics.numbered(uses.select("h").distinct(), ["h"], "id").withColumn("id", F.col("id") - 1)
    return uses.join(words, "h").groupBy("id", "h").agg(F.count(F.lit(1)).alias("n"))


# --- sampling, groups


@query("control_group", f"with {GA} select * from ga")
def control_group(spark, d):
    return _control(spark, d)


@query("sensor_b1", f"with {B1} select * from b1")
def sensor_b1(spark, d):
    return groups.sensors(_control(spark, d), _network(spark, d), SEED)


@query("sensor_b2", f"with {GA}, nb as (select distinct iteration, dst u from ga join net on net.src = ga.u) select iteration, u from nb qualify row_number() over (partition by iteration order by md5('{SEED}:' || iteration || ':' || u), u) <= {SIZE}")
def sensor_b2(spark, d):
    return groups.random_neighbours(_control(spark, d), _network(spark, d), SIZE, SEED)


@query("sensor_b3", f"with {GA}, nb as (select distinct iteration, dst u from ga join net on net.src = ga.u) select iteration, u from nb join us using (u) qualify row_number() over (partition by iteration order by nbr_hashtags desc, u) <= {SIZE}")
def sensor_b3(spark, d):
    return groups.best_neighbours(_control(spark, d), _network(spark, d), _users(spark, d), SIZE, "nbr_hashtags")


@query("sensor_b4", f"with {GA}, {SCORE.split(', sc as')[1].join(['sc as', ''])}, nb as (select distinct iteration, dst u from ga join net on net.src = ga.u) select iteration, u from nb join sc using (u) qualify row_number() over (partition by iteration order by lagtime, u) <= {SIZE}")
def sensor_b4(spark, d):
    scores = lag.user_scores(_users(spark, d), _births(spark, d), _per_user(spark, d))
    return groups.best_neighbours(_control(spark, d), _network(spark, d), scores, SIZE, "lagtime", descending=False)


TOPS = f"{US}, {SCORE.split(', sc as')[1].join(['sc as', ''])}"


@query("top_users_efg", f"with {TOPS} (select 'E' g, u from sc order by lagtime, u limit {SIZE}) union all (select 'F', u from us order by nbr_hashtags desc, u limit {SIZE}) union all (select 'G', u from us order by nbr_tweets desc, u limit {SIZE})")
def top_users_efg(spark, d):
    users = _users(spark, d)
    scores = lag.user_scores(users, _births(spark, d), _per_user(spark, d))
    parts = [("E", groups.top_users(scores, "lagtime", SIZE, False)), ("F", groups.top_users(users, "nbr_hashtags", SIZE)), ("G", groups.top_users(users, "nbr_tweets", SIZE))]
    out = [p.select(F.lit(g).alias("g"), "u") for g, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("groups_efg", f"with {EFG} select g \"group\", iteration, tid from ep")
def groups_efg(spark, d):
    return _efg(spark, d)


@query("random_mention", f"with {NET} select src, arg_min(dst, struct_pack(a := md5('{SEED}:' || src || ':' || dst), b := dst)) dst from net group by src")
def random_mention(spark, d):
    return sampling.one_per_key(_network(spark, d), "src", "dst", SEED)


@query("random_list_item", f"with {NET}, l as (select src, list(dst order by dst) x from net group by src) select src, x[(('0x' || substr(md5('{SEED}:' || src), 1, 8))::BIGINT % len(x)) + 1] item from l")
def random_list_item(spark, d):
    lists = _network(spark, d).groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("x"))
    return lists.select("src", sampling.random_item(F.col("x"), SEED, "src").alias("item"))


@query("exact_sample", f"with {TH} select tid from th order by md5('{SEED}:' || tid), tid limit 100")
def exact_sample(spark, d):
    return sampling.exactly(_uses(spark, d).select("tid"), 100, SEED, "tid")


@query("bernoulli_sample", f"with {TH} select tid, u from th where md5('{SEED}:' || tid) < '19999999'")
def bernoulli_sample(spark, d):
    return sampling.bernoulli(_uses(spark, d).select("tid", "u"), 0.1, SEED, "tid")


@query("negative_sample", f"with {DOCS}, p as (select count(*) n from docs where toxic = 1) select doc_id, toxic from docs where toxic = 1 union all select doc_id, toxic from (select doc_id, toxic, row_number() over (order by md5('{SEED}:' || doc_id), doc_id) r from docs where toxic = 0), p where r <= n * 9")
def negative_sample(spark, d):
    return sampling.negatives(_labelled(spark, d).select("doc_id", "toxic"), "toxic", 9, SEED, "doc_id")


@query("decimation", f"with {TH} select tid from (select tid, row_number() over (order by us, tid) r from th) where (r - 1) % 25 = 0")
def decimation(spark, d):
    return statistics.every_nth(_uses(spark, d).select("us", "tid"), 25, ["us", "tid"]).select("tid")


@query("tail_rows", f"with {TH} select tid from th order by us desc, tid desc limit 10")
def tail_rows(spark, d):
    return _uses(spark, d).orderBy(F.desc("us"), F.desc("tid")).limit(10).select("tid")


# --- information


@query("from_user_prob", f"with {TH} select u, round(count(*) / (select count(*) from th), 12) prob from th group by u")
def from_user_prob(spark, d):
    return _r(information.probabilities(_uses(spark, d), "u"), "prob", digits=12)


@query("to_user_prob", f"with {MN} select dst, round(count(*) / (select count(*) from mn), 12) prob from mn group by dst")
def to_user_prob(spark, d):
    return _r(information.probabilities(_mentions(spark, d), "dst"), "prob", digits=12)


TP = f"{TH}, tp as (select tid, u, max((h like 'click%')::INT) t from th group by all)"


def _topical(spark, d):
    return information.topical_posts(_uses(spark, d), F.col("h").startswith("click"))


@query("contains_counts", f"with {TP} select (2 - t)::INT bucket, count(*) n from tp group by t")
def contains_counts(spark, d):
    return information.contains_counts(_topical(spark, d))


@query("conditional_counts", f"with {TP}, n as (select count(*) n from tp) select u, round(sum(t) / any_value(n), 12) p_topical, round(sum(1 - t) / any_value(n), 12) p_other from tp, n group by u")
def conditional_counts(spark, d):
    return _r(information.conditional_counts(_topical(spark, d)), "p_topical", "p_other", digits=12)


ENT = f"""{TP}, tot as (select count(*) n, sum(t) c from tp), us1 as (select u, count(*) nu, sum(t) cu from tp group by u),
pr as (select u, nu / n pu, cu / n a, (nu - cu) / n b, (c - cu) / n cc, (n - c - nu + cu) / n dd from us1, tot)"""


def _ent(q):
    return " + ".join(f"case when {p} = 0 or {r} = 0 then 0 else {p} * ln({p} / ({r})) end" for p, r in (("a", "pu"), ("b", "pu"), ("cc", q), ("dd", q)))


@query("cond_entropy", f"with {ENT} select u, round(-({_ent('pu')}), 9) cond_entropy from pr")
def cond_entropy(spark, d):
    return _r(information.conditional_entropy(_topical(spark, d)), "cond_entropy")


@query("cond_entropy_normalised", f"with {ENT} select u, round(-({_ent('1 - pu')}), 9) cond_entropy from pr")
def cond_entropy_normalised(spark, d):
    return _r(information.conditional_entropy(_topical(spark, d), True), "cond_entropy")


@query("top_entropy_users", f"with {ENT}, e as (select u, round(-({_ent('pu')}), 9) cond_entropy from pr) select * from e order by cond_entropy, u limit 10")
def top_entropy_users(spark, d):
    return cond_entropy(spark, d).orderBy("cond_entropy", "u").limit(10)


def _mi_sql():
    cell = lambda x, f, c: f"case when {x} = 0 then 0 else ({x} / n) * log2(({x} / n) / (({f} / n) * ({c} / n))) end"
    parts = [cell("f1", "f", "n1"), cell("(f - f1)", "f", "(n - n1)"), cell("(n1 - f1)", "(n - f)", "n1"), cell("(n - n1 - f + f1)", "(n - f)", "(n - n1)")]
    return f"{WORDS}, tt as (select count(*)::DOUBLE n, sum(\"label\")::DOUBLE n1 from lb), ce as (select family, feature, count(*)::DOUBLE f, sum(\"label\")::DOUBLE f1 from wf join lb using (\"row\") group by all), mi as (select family, feature, {' + '.join(parts)} mi from ce, tt)"


MI = _mi_sql()


def _mi(spark, d):
    return information.mutual_information(_word_features(spark, d), _row_labels(spark, d), ["family", "feature"])


@query("mutual_information", f"with {MI} select family, feature, round(mi, 9) mi from mi")
def mutual_information(spark, d):
    return _r(_mi(spark, d), "mi")


@query("mi_top_by_family", f"with {MI}, r as (select family, feature, round(mi, 9) mi from mi) select family, feature, mi, row_number() over (partition by family order by mi desc, feature)::INT rank from r qualify rank <= 10")
def mi_top_by_family(spark, d):
    return information.top_per_group(mutual_information(spark, d), ["family"], "mi", 10, "feature")


MATRIX = f"{MI}, sc as (select family, substr(feature, 1, 1) topic, feature, round(mi, 9) mi from mi), cl as (select family, topic, avg(mi) * 1e8 m from (select *, row_number() over (partition by family, topic order by mi desc, feature) r from sc) where r <= 50 group by all)"


@query("mi_matrix", f"with {MATRIX} select family, topic, round(avg(m), 1) mean_mi from cl group by cube (family, topic)")
def mi_matrix(spark, d):
    scores = mutual_information(spark, d).withColumn("topic", F.substring("feature", 1, 1))
    return _r(information.mean_matrix(scores, k=50), "mean_mi", digits=1)


@query("topk_share", f"with {MI}, r as (select family, row_number() over (order by round(mi, 9) desc, feature, family) r from mi), k as (select unnest([10, 100, 1000]) k) select k::INT k, family, round(count(*) / sum(count(*)) over (partition by k), 9) share from r, k where r <= k group by k, family")
def topk_share(spark, d):
    scores = mutual_information(spark, d).withColumn("feature", F.concat_ws("\x01", "feature", "family"))
    return _r(information.family_shares(scores, [10, 100, 1000]), "share")


WHOLE_MATRIX = MATRIX.replace("where r <= 50", "where r <= 100000")


@query("mi_matrix_whole", f"with {WHOLE_MATRIX} select family, topic, round(avg(m), 1) mean_mi from cl group by cube (family, topic)")
def mi_matrix_whole(spark, d):
    """mi_matrix over the operator's own number of features, 100,000 per family and topic."""
    scores = mutual_information(spark, d).withColumn("topic", F.substring("feature", 1, 1))
    return _r(information.mean_matrix(scores), "mean_mi", digits=1)


@query("topk_share_whole", f"with {MI}, r as (select family, row_number() over (order by round(mi, 9) desc, feature, family) r from mi), k as (select unnest([10, 100, 1000, 10000, 100000]) k) select k::INT k, family, round(count(*) / sum(count(*)) over (partition by k), 9) share from r, k where r <= k group by k, family")
def topk_share_whole(spark, d):
    """topk_share up to the 100,000 best features."""
    scores = mutual_information(spark, d).withColumn("feature", F.concat_ws("\x01", "feature", "family"))
    return _r(information.family_shares(scores, [10, 100, 1000, 10_000, 100_000]), "share")


# --- statistics


@query("column_stdev", f"with {WORDS}, c as (select feature, \"row\", 1.0 v from wf where family = 'en') select feature, count(*) nnz, round(count(*) / (select count(*) from lb), 9) mean, round(sqrt(greatest((count(*) - count(*) * count(*) / (select count(*) from lb)) / ((select count(*) from lb) - 1), 0)), 9) stdev from c group by feature")
def column_stdev(spark, d):
    ones = _word_features(spark, d).filter("family = 'en'").withColumn("value", F.lit(1.0))
    n = _row_labels(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return _r(statistics.column_deviations(ones, n, "feature"), "mean", "stdev")


SCALED = "lp as (select l_linenumber f, l_quantity v from lineitem), ds as (select f, stddev_samp(v) s from lp group by f)"


@query("scaled_features", f"with {SCALED} select f, count(*) n, round(sum(v / s), 3) total from lp join ds using (f) group by f")
def scaled_features(spark, d):
    values = _t(spark, d, "lineitem").select(F.col("l_linenumber").alias("f"), F.col("l_quantity").alias("v"))
    deviations = values.groupBy("f").agg(F.stddev_samp("v").alias("stdev"))
    return _r(statistics.scaled(values, deviations, "f", "v").groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")), "total", digits=3)


@query("nnz_per_row", f"with {WORDS} select \"row\", count(*) nnz from wf group by 1")
def nnz_per_row(spark, d):
    return _word_features(spark, d).groupBy("row").agg(F.count(F.lit(1)).alias("nnz"))


@query("quartiles", "select event_type, round(quantile_cont(value, 0.25), 6) q1, round(quantile_cont(value, 0.5), 6) median, round(quantile_cont(value, 0.75), 6) q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) iqr from events group by 1")
def quartiles(spark, d):
    return _r(statistics.quartiles(_t(spark, d, "events"), "value", ["event_type"]), "q1", "median", "q3", "iqr", digits=6)


BIN = "case when x between 0 and 100 then 0 when x > 100 and x <= 1000 then 1 when x > 1000 and x <= 10000 then 2 when x > 10000 and x <= 100000 then 3 when x > 100000 and x <= 1000000 then 4 end"


@query("bins", f"select bin, count(*) n from (select {BIN} bin from (select o_totalprice x from orders union all select n_chars from documents)) where bin is not null group by bin")
def bins(spark, d):
    values = _t(spark, d, "orders").select(F.col("o_totalprice").alias("x")).unionByName(_t(spark, d, "documents").select(F.col("n_chars").cast("double").alias("x")))
    return values.select(sc.order_of_magnitude_bin(F.col("x")).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def _trim_sql(src, col):
    return f"select t.* from {src} t join (select bin, quantile_cont({col}, 0.25) a, quantile_cont({col}, 0.75) b from {src} group by bin) q using (bin) where {col} between a - 1.5 * (b - a) and b + 1.5 * (b - a)"


@query("iqr_outliers", f"with b as (select o_orderkey, o_custkey y, o_totalprice x, {BIN.replace('x ', 'o_totalprice ')} bin from orders), c as (select * from b where bin is not null), d as ({_trim_sql('c', 'y')}), e as ({_trim_sql('d', 'x')}) select bin, count(*) n, round(quantile_cont(y, 0.25), 6) q1, round(quantile_cont(y, 0.5), 6) median, round(quantile_cont(y, 0.75), 6) q3, round(quantile_cont(y, 0.75) - quantile_cont(y, 0.25), 6) iqr from e group by bin")
def iqr_outliers(spark, d):
    out = statistics.binned_distribution(_t(spark, d, "orders"), "o_totalprice", "o_custkey")
    return _r(out, "q1", "median", "q3", "iqr", digits=6)


@query("regr_trend", "select round(regr_slope(n_chars, doc_id), 6) slope, round(regr_intercept(n_chars, doc_id), 6) intercept from documents")
def regr_trend(spark, d):
    return _r(statistics.trend(_t(spark, d, "documents"), "doc_id", "n_chars"), "slope", "intercept", digits=6)


TOPICS = "tp as (select source topic, avg(n_chars) x, avg(doc_id) y from documents group by 1)"


@query("kendall_tau", f"with {TOPICS} select round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / count(*), 9) tau from tp a join tp b on a.topic < b.topic")
def kendall_tau(spark, d):
    topics = _t(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("x"), F.avg("doc_id").alias("y"))
    return _r(statistics.kendall_tau(topics, "source", "x", "y"), "tau")


@query("topic_ranks", f"with {TOPICS} select topic, rank() over (order by x desc)::INT x_rank, rank() over (order by y desc)::INT y_rank from tp")
def topic_ranks(spark, d):
    topics = _t(spark, d, "documents").groupBy(F.col("source").alias("topic")).agg(F.avg("n_chars").alias("x"), F.avg("doc_id").alias("y"))
    return topics.select("topic", F.rank().over(Window.orderBy(F.desc("x"))).alias("x_rank"), F.rank().over(Window.orderBy(F.desc("y"))).alias("y_rank"))


@query("mean_ci", "select lang, round(avg(n_chars), 6) mean, round(2.262157 * stddev_samp(n_chars) / sqrt(count(n_chars)), 6) half_width from documents group by lang")
def mean_ci(spark, d):
    return _r(statistics.mean_with_interval(_t(spark, d, "documents"), ["lang"], "n_chars"), "mean", "half_width", digits=6)


@query("feature_usage", f"with {TH}, c as (select split_part(h, '_', 1) family, h, count(*) n from th group by all) select family, max(n) most, round(avg(n), 6) mean, round(quantile_cont(n, 0.5), 6) median, arg_min(h, struct_pack(a := -n, b := h)) top from c group by family")
def feature_usage(spark, d):
    counts = _uses(spark, d).groupBy(F.split("h", "_")[0].alias("family"), "h").agg(F.count(F.lit(1)).alias("n"))
    return _r(statistics.usage(counts, "family", "h", "n"), "mean", "median", digits=6)


@query("frequency_cutoff", "with c as (select event_type family, (props->>'$.k') value, count(*) n from events group by all) select * from c where n >= case family when 'click' then 25 when 'view' then 20 else 15 end and family in ('click', 'view', 'purchase')")
def frequency_cutoff(spark, d):
    values = _t(spark, d, "events").select(F.col("event_type").alias("family"), F.get_json_object("props", "$.k").alias("value"))
    return statistics.frequent(values, {"click": 25, "view": 20, "purchase": 15})


# --- ranking metrics


HITS = f"{RANKED}, rk as (select *, row_number() over (partition by topic order by score desc, id) r from sc), hp as (select *, sum(\"label\") over (partition by topic order by r) / r p from rk where r <= 1000)"


@query("precision_at_k", f"with {HITS} select topic, round(sum(case when r <= 10 then \"label\" else 0 end) / 10, 9) p10, round(sum(case when r <= 100 then \"label\" else 0 end) / 100, 9) p100, round(sum(\"label\") / 1000, 9) p1000 from hp group by topic")
def precision_at_k(spark, d):
    return _r(metrics.precision_at(_ranking(spark, d), ["topic"]), "p10", "p100", "p1000")


@query("ap_at_k", f"with {HITS} select topic, round(coalesce(avg(case when \"label\" = 1 then p end), 0), 9) ap from hp group by topic")
def ap_at_k(spark, d):
    return _r(metrics.average_precision_at(_ranking(spark, d), ["topic"]), "ap")


@query("map", f"with {HITS}, ap as (select topic, coalesce(avg(case when \"label\" = 1 then p end), 0) ap from hp group by topic) select round(avg(ap), 9) \"map\" from ap")
def mean_ap(spark, d):
    return _r(metrics.mean_average_precision(metrics.average_precision_at(_ranking(spark, d), ["topic"])), "map")


@query("time_sliced_ap", HITS.join(["with ", " select slice, round(coalesce(avg(case when \"label\" = 1 then p end), 0), 9) ap from hp group by slice"]).replace("lang topic", "(doc_id % 20) slice, doc_id % 20 topic"))
def time_sliced_ap(spark, d):
    sliced = _ranking(spark, d).withColumn("slice", F.col("id") % 20)
    return _r(metrics.average_precision_at(sliced, ["slice"]), "ap")


# --- language


_GRAMS = r"zz as (select doc_id, lang, string_split(regexp_replace('_' || regexp_replace(lower(text), '[^\pL]+', '_', 'g') || '_', '_+', '_', 'g'), '') c from documents), gg as (select doc_id, lang, c[i] || c[i + 1] || c[i + 2] ngram from (select doc_id, lang, c, unnest(range(1, len(c) - 1)) i from zz) where c[i + 1] <> '_')"
_PROFILE = "pf as (select ngram, count(*) cnt from gg where lang = 'en' group by 1 order by cnt desc, ngram limit 1000)"


@query("trigram_profile", f"with {_GRAMS}, {_PROFILE} select * from pf")
def trigram_profile(spark, d):
    return language.profile(_t(spark, d, "documents").filter("lang = 'en'"))


@query("lang_distance", f"with {_GRAMS}, {_PROFILE}, m as (select doc_id, count(*) total, count(pf.ngram) matched from (select distinct doc_id, ngram from gg) left join pf using (ngram) group by 1), r as (select d.doc_id, coalesce(total, 0) total, coalesce(matched, 0) matched, 1 - matched / total distance from documents d left join m using (doc_id)) select doc_id, total, matched, round(distance, 9) distance, case when distance < 0.4 then 'en' else 'unknown' end \"language\", coalesce(distance < 0.022, false) certain from r")
def lang_distance(spark, d):
    docs = _t(spark, d, "documents")
    return _r(language.identified(language.distance(docs, trigram_profile(spark, d), "doc_id")), "distance")


def _profiles_sql(expr):
    return f"with {_GRAMS}, {_PROFILE}, p2 as (select ngram, count(*) cnt from gg where lang = 'de' group by 1 order by cnt desc, ngram limit 1000), j as (select ngram, a.cnt / (select sum(cnt) from pf) fa, b.cnt / (select sum(cnt) from p2) fb from pf a full join p2 b using (ngram)) select {expr} from j"


def _two_profiles(spark, d):
    docs = _t(spark, d, "documents")
    return language.profile(docs.filter("lang = 'en'")), language.profile(docs.filter("lang = 'de'"))


@query("profile_similarity", _profiles_sql("round(sum(case when fa is not null and fb is not null then abs(fa - fb) else coalesce(fa, fb) end), 9) similarity"))
def profile_similarity(spark, d):
    return _r(language.similarity(*_two_profiles(spark, d)), "similarity")


@query("profile_distance", _profiles_sql("round(sqrt(sum((coalesce(fa, 0) - coalesce(fb, 0)) ** 2)), 9) distance"))
def profile_distance(spark, d):
    return _r(language.frequency_distance(*_two_profiles(spark, d)), "distance")


# --- text: posts made of all events, whose entities are known from the columns


AB = "\U0001f6a2"
POST = "ev as (select event_id id, event_id % 5 kind, 'u' || user_id u, 'u' || (props->>'$.k') other, event_type || '_' || (props->>'$.k') tag, 'a' || (props->>'$.k') a, 'http://example.com/' || event_id || '#b' url, 'https://t.co/a' || event_id short from events)"
PS = f"""{POST}, ps as (select *, case kind when 0 then 'Mention @' || u || ' and #' || tag || ' plus #日本語 ' || url when 1 then 'RT @' || u || ': see www.example.com and $AB $brk.a'
  when 2 then ' @' || u || ' hello @' || other || '/list #1 #' || a || ' &#no' when 3 then 'no entities here < ' || id else short || '/more {AB} #' || a end t from ev)"""


def _posts(spark, d):
    """(id, text): five kinds of posts, from each event by its id."""
    e = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("u"), F.get_json_object("props", "$.k").alias("k"), "event_type")
    kinds = [
        F.concat(F.lit("Mention @"), "u", F.lit(" and #"), "event_type", F.lit("_"), "k", F.lit(" plus #日本語 http://example.com/"), "id", F.lit("#b")),
        F.concat(F.lit("RT @"), "u", F.lit(": see www.example.com and $AB $brk.a")),
        F.concat(F.lit(" @"), "u", F.lit(" hello @u"), "k", F.lit("/list #1 #a"), "k", F.lit(" &#no")),
        F.concat(F.lit("no entities here < "), "id"),
        F.concat(F.lit("https://t.co/a"), "id", F.lit(f"/more {AB} #a"), "k"),
    ]
    return e.select("id", F.element_at(F.array(*kinds), (F.col("id") % 5 + 1).cast("int")).alias("text"))


def _case(*values):
    return "case kind " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


@query("hashtag_extract", f"with {PS} select id, {_case('tag || ' + repr(',日本語'), repr(''), 'a', repr(''), 'a')} tags from ps")
def hashtag_extract(spark, d):
    return _posts(spark, d).select("id", F.array_join(entities.hashtags(F.col("text")), ",").alias("tags"))


@query("mention_extract", f"with {PS} select id, {_case('u', 'u', 'u', repr(''), repr(''))} users, {_case('u', 'u', 'u || ' + repr(',') + ' || other', repr(''), repr(''))} \"all\" from ps")
def mention_extract(spark, d):
    """Mentioned users, without and with owners of lists."""
    return _posts(spark, d).select("id", F.array_join(entities.mentions(F.col("text")), ",").alias("users"), F.array_join(entities.mentions(F.col("text"), True), ",").alias("all"))


@query("reply_extract", f"with {PS} select id, {_case('null', 'null', 'u', 'null', 'null')} \"user\" from ps")
def reply_extract(spark, d):
    return _posts(spark, d).select("id", entities.reply_to(F.col("text")).alias("user"))


@query("cashtag_extract", f"with {PS} select id, case when kind = 1 then 'AB,brk.a' else '' end tags from ps")
def cashtag_extract(spark, d):
    return _posts(spark, d).select("id", F.array_join(entities.cashtags(F.col("text")), ",").alias("tags"))


@query("url_extract", f"with {PS} select id, {_case('url', repr('www.example.com'), repr(''), repr(''), 'short')} urls from ps")
def url_extract(spark, d):
    found = entities.entities_udf(("URL",))(F.col("text"))
    return _posts(spark, d).select("id", F.array_join(F.transform(found, lambda e: e["value"]), ",").alias("urls"))


def _span(kind, start, length):
    return f"'{kind}:' || ({start}) || '-' || ({start} + {length})"


SPANS = _case(
    " || ',' || ".join([_span("MENTION", "strpos(t, '@') - 1", "1 + len(u)"), _span("HASHTAG", "strpos(t, '#') - 1", "1 + len(tag)"), _span("HASHTAG", "strpos(t, ' plus #') + 5", "4"), _span("URL", "strpos(t, 'http') - 1", "len(url)")]),
    " || ',' || ".join([_span("MENTION", "strpos(t, '@') - 1", "1 + len(u)"), _span("URL", "strpos(t, 'www') - 1", "15"), _span("CASHTAG", "strpos(t, '$AB') - 1", "3"), _span("CASHTAG", "strpos(t, '$AB') + 3", "6")]),
    " || ',' || ".join([_span("MENTION", "1", "1 + len(u)"), _span("MENTION", "strpos(t, 'hello @') + 5", "6 + len(other)"), _span("HASHTAG", "strpos(t, '#a') - 1", "1 + len(a)")]),
    "''",
    # the ship is two UTF-16 units
    " || ',' || ".join([_span("URL", "0", "len(short)"), _span("HASHTAG", "strpos(t, '#')", "1 + len(a)")]),
)


@query("entity_spans", f"with {PS} select id, {SPANS} spans from ps")
def entity_spans(spark, d):
    """All entities in UTF-16 units."""
    found = entities.entities_udf()(F.col("text"))
    return _posts(spark, d).select("id", F.array_join(F.transform(found, lambda e: F.format_string("%s:%d-%d", e["type"], e["start"], e["end"])), ",").alias("spans"))


BASE, TOP = "https://twitter.com/", ' target="_top"'


def _link_sql(kind, value, rel=' rel="nofollow"'):
    """The anchor of an entity, as SQL text."""
    if kind == "URL":
        return f"""'<a href="' || {value} || '"{rel}>' || {value} || '</a>'"""
    if kind in "#$":
        code, cls = ("%23", "hashtag") if kind == "#" else ("%24", "cashtag")
        return f"""'<a href="{BASE}#!/search?q={code}' || {value} || '" title="{kind}' || {value} || '" class="tweet-url {cls}"{rel}>{kind}' || {value} || '</a>'"""
    cls = "list-slug" if kind == "list" else "username"
    return f"""'@<a class="tweet-url {cls}" href="{BASE}' || {value} || '"{rel}>' || {value} || '</a>'"""


LINKS = _case(
    f"'Mention ' || {_link_sql('@', 'u')} || ' and ' || {_link_sql('#', 'tag')} || ' plus ' || {_link_sql('#', repr('日本語'))} || ' ' || {_link_sql('URL', 'url')}",
    f"'RT ' || {_link_sql('@', 'u')} || ': see www.example.com and ' || {_link_sql('$', repr('AB'))} || ' ' || {_link_sql('$', repr('brk.a'))}",
    f"' ' || {_link_sql('@', 'u')} || ' hello ' || {_link_sql('list', '(other || ' + repr('/list') + ')')} || ' #1 ' || {_link_sql('#', 'a')} || ' &#no'",
    "'no entities here &lt; ' || id",
    f"{_link_sql('URL', 'short')} || '/more {AB} ' || {_link_sql('#', 'a')}",
)


@query("autolink", f"with {PS} select id, {LINKS} html from ps")
def autolink(spark, d):
    return _posts(spark, d).select("id", entities.auto_link_udf()(F.col("text")).alias("html"))


USER_LINKS = _case(
    f"'Mention ' || {_link_sql('@', 'u', '')} || ' and #' || tag || ' plus #日本語 ' || url",
    f"'RT ' || {_link_sql('@', 'u', '')} || ': see www.example.com and $AB $brk.a'",
    f"' ' || {_link_sql('@', 'u', '')} || ' hello ' || {_link_sql('list', '(other || ' + repr('/list') + ')', '')} || ' #1 #' || a || ' &#no'",
    "t",
    "t",
)
URL_LINKS = _case(f"'Mention @' || u || ' and #' || tag || ' plus #日本語 ' || {_link_sql('URL', 'url', TOP)}", "t", "t", "t", f"{_link_sql('URL', 'short', TOP)} || '/more {AB} #' || a")


@query("autolink_kinds", f"with {PS} select id, {USER_LINKS} users, {URL_LINKS} urls from ps")
def autolink_kinds(spark, d):
    """Links of one kind only, with options: users and lists without rel, URLs with a target."""
    users = entities.auto_link_udf(entities.LinkOptions(types=("MENTION",), no_follow=False))
    urls = entities.auto_link_udf(entities.LinkOptions(types=("URL",), no_follow=False, url_target="_top"))
    return _posts(spark, d).select("id", users(F.col("text")).alias("users"), urls(F.col("text")).alias("urls"))


@query("highlight", f"with {PS} select id, '<em>' || t[1:4] || '</em>' || t[5:] html from ps")
def highlight(spark, d):
    return _posts(spark, d).select("id", entities.highlight_udf("text", F.array(F.array(F.lit(0), F.lit(4)))).alias("html"))


@query("tweet_length", f"with {PS}, n as (select id, len(t) + {_case('22 - len(url)', '7', '0', '0', '23 - len(short)')} n from ps) select id, n::INT length, n <= 140 valid from n")
def tweet_length(spark, d):
    return _posts(spark, d).select("id", entities.post_length_udf("text").alias("length"), entities.is_valid_post_udf("text").alias("valid"))


# --- scalars


@query("scalar_functions", """with e as (select event_id, ts, user_id::VARCHAR u, epoch_us(ts) // 1000 % 86400000 // 1000 s, event_id / 7 x from events)
select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') parsed, null::VARCHAR bad, strftime(ts, '%Y-%m-%d') "day", (s // 3600) || ' hour, ' || (s % 3600 // 60) || ' min, ' || (s % 60) || ' sec' dur, true num, false word, false special, true mark,
  u || ',' || event_id items, 2 n_list, md5(u) digest, regexp_replace(printf('%.2f', x), '[.]?0+$', '') two from e where event_id % 100 <> 0 union all
select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), null, strftime(ts, '%Y-%m-%d'), (s // 3600) || ' hour, ' || (s % 3600 // 60) || ' min, ' || (s % 60) || ' sec', true, false, false, true, u || ',' || event_id, 2, md5(u), regexp_replace(regexp_replace(printf('%.2f', x), '0+$', ''), '[.]$', '') from e where event_id % 100 = 0""")
def scalar_functions(spark, d):
    e = _t(spark, d, "events").select("event_id", "ts", F.col("user_id").cast("string").alias("u"))
    return e.select(
        "event_id", sc.format_time(sc.parse_created_at(F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy"))).alias("parsed"), sc.format_time(sc.parse_created_at(F.concat(F.lit("x"), "u"))).alias("bad"),
        F.date_format(sc.parse_day(F.date_format("ts", "dd/MM/yyyy")), "yyyy-MM-dd").alias("day"), sc.duration(F.floor(sc.micros("ts") / 1000) % 86_400_000).alias("dur"), sc.is_numeric(F.col("u")).alias("num"), sc.is_numeric(F.concat("u", F.lit(".1.2"))).alias("word"),
        sc.is_special_char(F.substring("u", 1, 1)).alias("special"), sc.is_special_char(F.lit(":")).alias("mark"), sc.join_items(sc.split_items(F.concat_ws(" ,, ", "u", "event_id"))).alias("items"),
        F.size(sc.split_list(F.concat_ws(",", "u", "event_id", F.lit("")))).alias("n_list"), F.md5("u").alias("digest"), sc.two_digits(F.col("event_id") / 7).alias("two"),
    )


@query("time_difference", "select event_id, (epoch_us(ts) // 1000000 - 1704067200)::BIGINT \"seconds\" from events")
def time_difference(spark, d):
    return _t(spark, d, "events").select("event_id", (F.floor(sc.micros("ts") / 1_000_000) - 1704067200).cast("long").alias("seconds"))


@query("json_roundtrip", "select event_id, '{\"id\":' || event_id || ',\"screen_name\":\"' || user_id || '\",\"text\":null}' line from events")
def json_roundtrip(spark, d):
    from tagtide.sources.posts import to_json_lines

    rows = _t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("screen_name"), F.lit(None).cast("string").alias("text"))
    return to_json_lines(rows).select(F.from_json("value", "id long")["id"].alias("event_id"), F.col("value").alias("line"))


# --- the same functions over whole tables


def _texts(name, make):
    """Registers a function of text over all documents, one row each."""
    QUERIES[name] = lambda spark, d: _t(spark, d, "documents").select(F.col("doc_id").alias("id"), *make("text"))


def _spans(c):
    return F.transform(entities.entities_udf()(F.col(c)), lambda e: F.format_string("%s:%d-%d", e["type"], e["start"], e["end"]))


_texts("hashtag_extract_documents", lambda c: [F.array_join(entities.hashtags(F.col(c)), ",").alias("tags")])
_texts("mention_extract_documents", lambda c: [F.array_join(entities.mentions(F.col(c)), ",").alias("users")])
_texts("reply_extract_documents", lambda c: [entities.reply_to(F.col(c)).alias("user")])
_texts("cashtag_extract_documents", lambda c: [F.array_join(entities.cashtags(F.col(c)), ",").alias("tags")])
_texts("url_extract_documents", lambda c: [F.array_join(F.transform(entities.entities_udf(("URL",))(F.col(c)), lambda e: e["value"]), ",").alias("urls")])
_texts("entity_spans_documents", lambda c: [F.array_join(_spans(c), ",").alias("spans")])
_texts("autolink_documents", lambda c: [entities.auto_link_udf()(F.col(c)).alias("html")])
_texts("highlight_documents", lambda c: [entities.highlight_udf(F.col(c), F.transform(entities.entities_udf()(F.col(c)), lambda e: F.array(e["start"], e["end"]))).alias("html")])
_texts("tweet_length_documents", lambda c: [entities.post_length_udf(c).alias("length"), entities.is_valid_post_udf(c).alias("valid")])


# --- models


@query("knn_exact", """with e as (select vec_id, embedding::DOUBLE[] v, ("label" = 1)::INT y from embeddings), d as (select t.vec_id id, s.vec_id o, t.y "label", s.y, list_sum(list_transform(range(1, 65), lambda i: (t.v[i] - s.v[i]) * (t.v[i] - s.v[i]))) d from e t join e s on s.vec_id % 10 <> 0 where t.vec_id % 10 = 0), r as (select *, row_number() over (partition by id order by d, o) r from d) select id, "label"::DOUBLE "label", round(avg(y), 9) score from r where r <= 5 group by all""")
def knn_exact(spark, d):
    from tagtide.operators.ranking_models import nearest_neighbours

    rows = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") == 1).cast("double").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return _r(nearest_neighbours(rows.filter("id % 10 <> 0"), rows.filter("id % 10 = 0"), 5), "score")


N_FEATURES = 100
# the vectors as rows: fx (feature, idx), hit (id, idx) of the ones, lbl (id, y); every fifth document is for testing
VECTORS = f"""{MI}, fx as (select feature, row_number() over (order by m desc, feature) - 1 idx from (select feature, round(max(mi), 12) m from mi group by 1) order by m desc, feature limit {N_FEATURES}),
hit as (select "row" id, idx from wf join fx using (feature)), lbl as (select "row" id, "label" y from lb), size as (select y, count(*)::DOUBLE n from lbl where id % 5 <> 0 group by y),
mean as (select y, idx, count(h.idx) / any_value(n) m from (select id, y, n, idx from lbl join size using (y), fx where id % 5 <> 0) x left join hit h using (id, idx) group by y, idx), ask as (select id, y from lbl where id % 5 = 0)"""


def _vectors(spark, d, n=N_FEATURES):
    """Documents as vectors of their most informative words, (train, test)."""
    from tagtide.operators import ranking_models as rm

    ranking = _mi(spark, d).groupBy(F.col("feature").alias("feature_id")).agg(F.round(F.max("mi"), 12).alias("mi"))
    words = _word_features(spark, d).select(F.col("row").alias("id"), F.col("feature").alias("feature_id"), F.lit(1.0).alias("value"))
    chosen = rm.select_features(words, ranking, n)
    rows = _row_labels(spark, d).withColumnRenamed("row", "id")
    v = kept(rm.to_vectors(rows, chosen.select("id", "idx", "value"), n))
    return v.filter("id % 5 <> 0"), v.filter("id % 5 = 0")


def _scaled(train, test):
    from tagtide.operators import ranking_models as rm

    s = rm.scaler(train)
    return rm.scale(s, train), rm.scale(s, test)


def _model(name, **options):
    def run(spark, d):
        from tagtide.operators import ranking_models as rm

        train, test = _vectors(spark, d)
        if name in ("logistic_regression", "linear_svm", "random_forest"):
            train, test = _scaled(train, test)
        return getattr(rm, name)(train, test, **options)

    return run


QUERIES["lr_rank"] = _model("logistic_regression", iterations=20)
QUERIES["svm_rank"] = _model("linear_svm", iterations=20)
QUERIES["rf_rank"] = _model("random_forest", trees=20)


@query("rocchio_rank", f"""with {VECTORS}, len as (select y, sqrt(sum(m * m)) l from mean group by y), own as (select id, sqrt(count(*)) k from hit group by id)
select ask.id, ask.y::DOUBLE "label", round(coalesce(sum(case mean.y when 1 then m else -m end / l / k), 0), 9) score from ask left join own using (id) left join hit using (id) left join mean using (idx) left join len on len.y = mean.y group by ask.id, ask.y""")
def rocchio_rank(spark, d):
    return _r(_model("rocchio")(spark, d), "score")


@query("nb_rank", f"""with {VECTORS}, total as (select sum(n) t from size), eps as (select max(q / t - s * s / t / t) * 1e-9 e from (select idx, sum(m * n) q, sum(m * n) s from mean join size using (y) group by idx), total),
var as (select y, idx, m, m - m * m + e v from mean, eps), joint as (select v.id, v.y, ln(any_value(n)) - ln(any_value(t)) - sum((case when h.idx is null then 0 else 1 end - m) ** 2 / (2 * v.v) + ln(v.v) / 2) j from (select ask.id, var.* from ask, var) v left join hit h on h.id = v.id and h.idx = v.idx join size on size.y = v.y cross join total group by v.id, v.y),
best as (select id, max(j) b from joint group by id) select id, ask.y::DOUBLE "label", round(sum(case joint.y when 1 then exp(j - b) else 0 end) / sum(exp(j - b)), 6) score from ask join joint using (id) join best using (id) group by id, ask.y""")
def nb_rank(spark, d):
    return _r(_model("naive_bayes", kind="gaussian")(spark, d), "score", digits=6)


def _quality(name, **options):
    """Rows, positives, and whether the model ranks better than chance would: its average precision is above the share of positives."""

    def run(spark, d):
        scores = kept(_model(name, **options)(spark, d).withColumn("label", F.col("label").cast("int")).withColumn("g", F.lit(1)))
        base = scores.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))
        ap = metrics.average_precision_at(scores, ["g"])
        return base.join(ap, "g").select("n", "positives", (F.col("ap") > 1.5 * F.col("positives") / F.col("n")).alias("better"))

    return run


BETTER = f"with {DOCS} select count(*) n, sum(toxic)::BIGINT positives, true better from docs where doc_id % 5 = 0"
query("lr_quality", BETTER)(_quality("logistic_regression", iterations=20))
query("svm_quality", BETTER)(_quality("linear_svm", iterations=20, probabilities=True))
query("rf_quality", BETTER)(_quality("random_forest", trees=20))


def _grid(spark, d, grid):
    """The documents packed for tuning, with their most informative words at the largest number of features, and the points of a grid."""
    from tagtide.operators import grid as packing

    ranking = kept(_mi(spark, d).groupBy("feature").agg(F.round(F.max("mi"), 12).alias("mi")))
    points = grid.settings(ranking.count())
    size = max((n for _, n, _ in points), default=0)
    best = ranking.orderBy(F.desc("mi"), "feature").limit(size).withColumn("idx", F.row_number().over(Window.orderBy(F.desc("mi"), "feature")) - 1)
    packed = _word_features(spark, d).join(F.broadcast(best), "feature").groupBy("row").agg(F.array_sort(F.collect_list("idx")).alias("idx"))
    part = F.when(F.col("row") % 5 == 0, packing.ASK).when(F.col("row") % 5 == 1, packing.CHECK).otherwise(packing.FIT)
    rows = _row_labels(spark, d).join(packed, "row", "left").select(F.col("row").alias("id"), F.col("label").cast("double").alias("label"), part.alias("part"), F.coalesce("idx", F.array().cast("array<int>")).alias("idx"))
    return packing.Packed(spark, rows, size), points


def grid_search(spark, d):
    """Every model, value and number of features of the grid on a fixed validation set, best first."""
    from tagtide.operators import grid, ranking_models

    packed, points = _grid(spark, d, ranking_models.Grid())
    return spark.createDataFrame([(i, m, n, v, float(ap)) for i, (ap, (m, n, v)) in enumerate(grid.tune(packed, points), 1)], "rank int, model string, features int, value double, ap double")


def ranking_pipeline(spark, d):
    """P@10, P@100, P@1000 and AP@1000 of logistic regression tuned over all values of C and numbers of features, overall and per time slice (a quarter of the ids each)."""
    from tagtide.operators import grid, ranking_models

    packed, points = _grid(spark, d, ranking_models.Grid())
    best = grid.tune(packed, [p for p in points if p[0] == "logistic_regression"])[0][1]
    sliced = kept(grid.linear_scores(packed, best, 10)).withColumn("slice", F.explode(F.array(F.lit(-1).cast("long"), F.col("id") % 4)))
    return metrics.precision_at(sliced, ["slice"]).join(metrics.average_precision_at(sliced, ["slice"]), "slice")


QUERIES["grid_search"] = grid_search
QUERIES["ranking_pipeline"] = ranking_pipeline


@query("learner_rows", f"""with {VECTORS} select any_value(y) || ' ' || coalesce(string_agg((idx + 1) || ':1', ' ' order by idx), '') "value" from ask left join hit using (id) group by id""")
def learner_rows(spark, d):
    """The test vectors as the text that linear and kernel learners read."""
    from tagtide.operators.ranking_models import libsvm_rows

    return libsvm_rows(_vectors(spark, d)[1])


@query("instance_rows", f"""with {VECTORS} select '{{' || coalesce(string_agg(idx || ' 1', ',' order by idx) || ',', '') || '{N_FEATURES} ' || any_value(y) || '}}' "value" from ask left join hit using (id) group by id""")
def instance_rows(spark, d):
    """The test vectors as sparse instances, the class last."""
    from tagtide.operators.ranking_models import arff_rows

    return arff_rows(_vectors(spark, d)[1], N_FEATURES)


@query("hashtag_birthday_stream", SQL["hashtag_birthday"])
def hashtag_birthday_stream(spark, d):
    """The same table from a stream over the events' files, each batch's changes written and the latest read back."""
    from tagtide.sources.posts import stream_checkpoint, work_folder
    from tagtide.streaming.birthdays import latest, live_birthdays, start

    path = f"{d}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")
    folder = work_folder(spark, "birthdays")
    start(live_birthdays(tables.event_uses(events)), folder, stream_checkpoint(spark)).awaitTermination()
    return latest(spark, folder, "h string, birthday long, nbr_tweets long", ["h"])


from tagtide.plans import formats  # noqa: E402, F401
