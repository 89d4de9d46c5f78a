"""Spelling variants: words and their near words, one inserted, deleted or replaced character apart, without pairs.

A word that lacks its character at a place meets its replacements in the group of that place, the letters before it and those
after it: a group keeps its size and its two most frequent words, so a word reads there how many others it has and which
is the most frequent. The alphabet bounds a group. Words that miss one character are looked up among the words themselves: that
finds what is one deletion away, and, counted at the shorter word, what is one insertion away. Both kinds are summed to
one row to a word. A word's form is the most frequent near word if it is at least TIMES as frequent; forms lead to roots by doubling
the steps, so rounds are the logarithm of the longest chain, which frequencies that double keep short. Every join is a merge join at
every size: both sides grow with the vocabulary, and a table of words that is small as a file is many times larger in a broadcast, which the driver holds.

Null and empty texts have no words; null ids count as empty in the hash of a run; repeated rows count each for itself. Of near words as
frequent the smallest in code-point order is the form. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import stored, table

RUN, LEAST_CHARS, LEAST_COUNT, EVERY, TIMES = "[A-Za-z\\u00C0-\\u00FF]+", 5, 3, 97, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for any one character; it is no letter.
ANY = "*"


def _without(word: str, at: str) -> str:
    """The SQL of a word without its code point at a place from 0."""
    return f"concat(substring({word}, 1, {at}), substring({word}, {at} + 2))"


def _met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of two tables of words, never a broadcast."""
    return left.join(right.hint("merge"), on, how)


def runs(docs: DataFrame) -> DataFrame:
    """``run`` and ``n``: every run of letters of every text, A-Z in lower case, one character deleted where its hash with the document's id says so, and how often it stands in all texts."""
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    each = each.select("id", F.translate("run", _UPPER, _LOWER).alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    cut = F.when(F.col("h") % EVERY == 0, F.expr(_without("run", "cast(h % length(run) as int)"))).otherwise(F.col("run"))
    return each.select(cut.alias("run")).where(F.length("run") >= LEAST_CHARS).groupBy("run").agg(F.count("*").alias("n"))


def words(docs: DataFrame) -> DataFrame:
    """word and n of all words frequent enough, as a stored table."""
    return stored(runs(docs).where(F.col("n") >= LEAST_COUNT).select(F.col("run").alias("word"), "n"), "spelling-words")


def _ranked() -> Column:
    """The more frequent word first, of words as frequent the smallest."""
    return F.struct((-F.col("n")).alias("less"), F.col("word"))


def replacements(vocabulary: DataFrame) -> DataFrame:
    """word, how many words of its wildcard groups are others, and the best of them, one row to a word and place where there is one."""
    places = vocabulary.select("word", "n", F.explode(F.expr("sequence(0, length(word) - 1)")).alias("at"))
    posted = places.select("word", "n", F.expr(f"concat(substring(word, 1, at), '{ANY}', substring(word, at + 2))").alias("key"))
    # a group has at most as many words as there are letters
    groups = posted.groupBy("key").agg(F.count("*").alias("size"), F.slice(F.sort_array(F.collect_list(_ranked())), 1, 2).alias("top")).where("size > 1")
    met = _met(posted, groups, "key")
    other = F.when(F.col("top")[0]["word"] != F.col("word"), F.col("top")[0]).otherwise(F.col("top")[1])
    return met.select("word", (F.col("size") - 1).alias("others"), other.alias("best"))


def indels(vocabulary: DataFrame) -> DataFrame:
    """As ``replacements``: each word that is another without one character, from both sides. A doubled letter's deletions are one."""
    shorter = vocabulary.where(F.length("word") > LEAST_CHARS).select("word", "n", F.explode(F.array_distinct(F.expr(f"transform(sequence(0, length(word) - 1), i -> {_without('word', 'i')})"))).alias("short"))
    met = _met(shorter, vocabulary.select(F.col("word").alias("short"), F.col("n").alias("short_n")), "short")
    down = met.select("word", F.lit(1).cast("long").alias("others"), F.struct((-F.col("short_n")).alias("less"), F.col("short").alias("word")).alias("best"))
    up = met.groupBy("short").agg(F.count("*").alias("others"), F.min(_ranked()).alias("best")).withColumnRenamed("short", "word")
    return down.unionByName(up)


def forms(vocabulary: DataFrame) -> DataFrame:
    """word, n, form, form_n and n_near of a stored vocabulary."""
    near = replacements(vocabulary).unionByName(indels(vocabulary)).groupBy("word").agg(F.sum("others").alias("n_near"), F.min("best").alias("best"))
    all_words = _met(vocabulary, near, "word", "left")
    led = -F.col("best.less") >= TIMES * F.col("n")
    return all_words.select("word", "n", F.when(led, F.col("best.word")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def doubled(now: DataFrame) -> DataFrame:
    """word, root and whether it moved: each word at the root of its root, if that has one."""
    ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
    return _met(now, ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))


def roots(formed: DataFrame) -> DataFrame:
    """word and root of every word that has a form: steps double each round, each round is stored, until every word is at a root."""
    now = stored(formed.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        moved = stored(doubled(now), "spelling-roots")
        now = moved.select("word", "root")
        if not moved.where("moved").take(1):
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of ``docs`` (doc_id, text)."""
    formed = stored(forms(words(docs)), "spelling-forms")
    return _met(formed, roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of all documents."""
    return variants(table(spark, sf_dir, "documents"))


def _remainder(x: int) -> int:
    """What crc32 adds for four bits."""
    for _ in range(4):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


#: crc32 in DuckDB, which has no such function: four bits of a string's bytes at a time, by their hexadecimal digits, the lower half of a byte first.
_BITS = "list_transform(range(0, cast(length(hx) as bigint)), lambda i: cast('0x' || substr(hx, cast(xor(i, 1) + 1 as bigint), 1) as bigint))"
_CRC = f"xor(list_reduce({_BITS}, lambda c, b: xor(c >> 4, {[_remainder(i) for i in range(16)]}[cast(xor(c, b) & 15 as bigint) + 1]), 4294967295::bigint), 4294967295)"

ORACLE = rf"""with recursive d as (select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
  r as (select id, translate(run, '{_UPPER}', '{_LOWER}') as run, count(*) as k from d group by 1, 2), x as (select run, k, hex(encode(id || ':' || run)) as hx from r), h as (select run, k, {_CRC} as h from x),
  c as (select case when h % {EVERY} = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) + 2 as bigint)) else run end as word, k from h),
  v as (select word, cast(sum(k) as bigint) as n from c where length(word) >= {LEAST_CHARS} group by 1 having sum(k) >= {LEAST_COUNT}),
  p as (select word, n, unnest(range(0, length(word))) as i from v), g as (select word, n, substr(word, 1, i) || '{ANY}' || substr(word, i + 2) as key from p),
  s as (select distinct word, n, substr(word, 1, i) || substr(word, i + 2) as short from p), j as (select s.word, s.n, v.word as short, v.n as short_n from s join v on v.word = s.short),
  near as (select a.word, b.word as other, b.n as other_n from g a join g b on a.key = b.key and a.word <> b.word union all select word, short, short_n from j union all select short, word, n from j),
  b as (select word, count(*) as n_near, max(other_n) as top from near group by 1), best as (select b.word, b.n_near, b.top, min(near.other) as other from b join near on near.word = b.word and near.other_n = b.top group by 1, 2, 3),
  f as (select v.word, v.n, coalesce(best.n_near, 0) as n_near, case when best.top >= {TIMES} * v.n then best.other end as form, case when best.top >= {TIMES} * v.n then best.top end as form_n from v left join best using (word)),
  walk as (select word, coalesce(form, word) as root, 0 as steps from f union all select w.word, f.form, w.steps + 1 from walk w join f on f.word = w.root where f.form is not null)
  select f.word, f.form, arg_max(w.root, w.steps) as root, f.n, f.n_near, f.form_n from f join walk w on w.word = f.word group by all"""
