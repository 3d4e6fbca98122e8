"""Chapters, pages, files, caches, corrections and reading state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetext.operators.spend import fmt_ago

#: Media types by extension. Fixed values.
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}
BLANK = "—"
SEPARATOR = "␟"
#: Display names by language code; others show the code in capitals. Fixed values.
LANGUAGES = {"vi": "Vietnamese", "it": "Italian", "pt": "Portuguese", "pt-br": "Portuguese (BR)", "ru": "Russian", "fr": "French", "es": "Spanish", "de": "German", "ja": "Japanese", "ko": "Korean", "zh": "Chinese", "zh-hk": "Chinese (HK)", "en": "English"}


def pick(key: Column, table: dict[str, str]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def natural_key(path: Column) -> Column:
    """Runs of digits and of other characters; two digit runs compare as numbers, whatever their length, else as text."""
    runs = F.regexp_extract_all(F.lower(path), F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda r: F.regexp_replace(r, "^0+(?=.)", "")
    return F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.concat(F.lpad(F.length(number(r)).cast("string"), 10, "0"), number(r))).otherwise(r))


def page_files(paths: DataFrame) -> DataFrame:
    """Image rows of paths(path) with mime and page_idx, by natural order in their folder; folders of
    metadata, dotfiles and comic notes are left out."""
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    mime = pick(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)), IMAGE_TYPES)
    kept = paths.withColumn("folder", folder).withColumn("mime", mime).where(mime.isNotNull() & ~F.contains("path", F.lit("__MACOSX/")) & ~F.startswith(name, F.lit(".")) & (F.lower(name) != "comicinfo.xml"))
    return kept.withColumn("page_idx", F.row_number().over(Window.partitionBy("folder").orderBy(natural_key(name), name, "path")) - 1)


def eval_listing(paths: DataFrame) -> DataFrame:
    """paths with the language before the first _ of the name; without one the row stays, as unmatched."""
    code = F.regexp_extract(F.element_at(F.split("path", "/"), -2), "^([a-z]{2})_", 1)
    return paths.withColumn("eval_lang", F.when(code != "", code)).withColumn("matched", code != "")


def slug(c: Column) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(F.coalesce(s, F.lit("")) == "", "untitled").otherwise(s)


def series_key(series_id: Column, name: Column) -> Column:
    return F.when(F.coalesce(series_id.cast("string"), F.lit("")) != "", F.concat(F.lit("id:"), series_id.cast("string"))).otherwise(F.concat(F.lit("name:"), slug(name)))


def safe_name(c: Column) -> Column:
    s = F.left(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_-]+", "_"), F.lit(60))
    return F.when(s == "", "chapter").otherwise(s)


def title_from_path(c: Column, default: str = "Untitled") -> Column:
    s = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)\.(cbz|zip)$", ""), r"[_.]+", " "))
    return F.when(s == "", default).otherwise(s)


def url_verdict(urls: DataFrame, hosts: tuple[str, ...], exact: str) -> DataFrame:
    """urls with verdict and reason: https to a host or its subdomains, or plain http to the exact host:port."""
    scheme = F.lower(F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    netloc = F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(netloc, "^.*@", ""), r":\d*$", "")
    inside = F.lit(False)
    for h in hosts:
        inside |= (host == h) | F.endswith(host, F.lit("." + h))
    reason = F.when((scheme == "http") & (netloc == exact), "local").when(host == "", "no host").when(scheme != "https", "not https").when(inside, "allowed").otherwise("host")
    return urls.select("*", reason.isin("local", "allowed").alias("ok"), reason.alias("reason"))


def payload_guard(df: DataFrame, column: str = "payload", most: int = 25 << 20) -> DataFrame:
    """df with verdict and n_bytes of a base64 payload, a data: prefix aside."""
    body = F.regexp_replace(column, "^data:[^,]*,", "")
    raw = F.try_to_binary(body, F.lit("base64"))
    verdict = F.when(F.length(body) > most * 4 // 3, "too_large").when(F.trim(body) == "", "empty").when(raw.isNull(), "bad_base64").when(F.octet_length(raw) > most, "too_large").otherwise("ok")
    return df.withColumn("verdict", verdict).withColumn("n_bytes", F.when(verdict == "ok", F.octet_length(raw)))


def lang_name(c: Column) -> Column:
    return F.coalesce(pick(F.lower(c), LANGUAGES), F.upper(c))


def lang_base(c: Column) -> Column:
    return F.upper(F.split_part(c, F.lit("-"), F.lit(1)))


#: Codes of a translation provider by target language; others it doesn't have. Fixed values.
TARGET_CODES = {
    "English": "EN-US", "Malay": "MS", "Indonesian": "ID", "Filipino": "TL", "Japanese": "JA", "Chinese (Simplified)": "ZH-HANS",
    "Chinese (Traditional)": "ZH-HANT", "Korean": "KO", "Thai": "TH", "Vietnamese": "VI", "Hindi": "HI", "Bengali": "BN",
    "Tamil": "TA", "Burmese": "MY", "Spanish": "ES", "French": "FR", "German": "DE", "Portuguese": "PT-PT",
    "Portuguese (Brazil)": "PT-BR", "Italian": "IT", "Russian": "RU", "Polish": "PL", "Dutch": "NL", "Turkish": "TR",
    "Ukrainian": "UK", "Czech": "CS", "Romanian": "RO", "Hungarian": "HU", "Swedish": "SV", "Danish": "DA",
    "Norwegian": "NB", "Finnish": "FI", "Greek": "EL", "Arabic": "AR", "Persian": "FA", "Hebrew": "HE", "Swahili": "SW",
}


def target_code(name: Column) -> Column:
    """The provider's code of a target language, null where it has none."""
    return pick(name, TARGET_CODES)


def chapter_id(url: Column) -> Column:
    """The UUID after chapter/, null without one."""
    found = F.regexp_extract(url, "(?i)chapter/([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1)
    return F.when(found != "", found)


def split_composite_id(key: Column, kind: str, plain: str) -> Column:
    """(kind, series, chapter) of `kind:series:chapter`; any other key is a chapter of the plain kind."""
    parts = F.split(key, ":")
    whole = (F.size(parts) == 3) & (F.get(parts, F.lit(0)) == kind)
    return F.struct(F.when(whole, kind).otherwise(plain).alias("kind"), F.when(whole, F.get(parts, F.lit(1))).alias("series"), F.when(whole, F.get(parts, F.lit(2))).otherwise(key).alias("chapter"))


def chapter_meta(feed: DataFrame, body: str = "body") -> DataFrame:
    """feed with title, manga_id, chapter, language and groups of landed chapter JSON."""
    rel = "array<struct<type:string,id:string,attributes:struct<title:map<string,string>,name:string>>>"
    j = F.from_json(body, f"struct<id:string,attributes:struct<chapter:string,translatedLanguage:string>,relationships:{rel}>")
    r = feed.withColumn("_j", j)
    manga = F.get(F.filter("_j.relationships", lambda x: x["type"] == "manga"), F.lit(0))
    titles = manga["attributes"]["title"]
    groups = F.transform(F.filter("_j.relationships", lambda x: (x["type"] == "scanlation_group") & x["attributes"]["name"].isNotNull()), lambda x: F.struct(x["attributes"]["name"].alias("name"), x["id"].alias("id")))
    title = F.coalesce(F.try_element_at(titles, F.lit("en")), F.get(F.map_values(titles), F.lit(0)), F.lit("Untitled"))
    return r.select(*feed.columns, title.alias("title"), manga["id"].alias("manga_id"), F.coalesce("_j.attributes.chapter", F.lit("?")).alias("chapter"), F.coalesce("_j.attributes.translatedLanguage", F.lit("en")).alias("language"), groups.alias("groups"))


def chapter_feed(pages: DataFrame, key: str = "series_id", order: tuple[str, ...] = ("released", "chapter_id")) -> DataFrame:
    """Landed feed pages as one feed for each series: no repeats, numbered. Of rows that repeat a chapter the
    first in order stays, ties by a hash of the row."""
    first = F.row_number().over(Window.partitionBy(key, "chapter_id").orderBy(*order, F.xxhash64(*pages.columns)))
    once = pages.withColumn("_first", first).where("_first = 1").drop("_first")
    return once.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def adjacent(feed: DataFrame, key: str = "series_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy("n")
    return feed.withColumn("prev_id", F.lag("chapter_id").over(w)).withColumn("next_id", F.lead("chapter_id").over(w))


def next_n(feed: DataFrame, starts: DataFrame, n: int, key: str = "series_id") -> DataFrame:
    """The n items after each of starts(key, chapter_id)."""
    at = feed.join(starts, [key, "chapter_id"], "left_semi").select(key, F.col("chapter_id").alias("start_id"), F.explode(F.sequence(F.col("n") + 1, F.col("n") + n)).alias("n"))
    return at.join(feed.select(key, "n", "chapter_id"), [key, "n"]).select(key, "start_id", "n", "chapter_id")


def page_urls(chapters: DataFrame, saver: bool) -> DataFrame:
    """One row a file of chapters(chapter_id, base, hash, full, small): the saver list only if asked for and not empty."""
    small = F.lit(saver) & (F.size(F.coalesce("small", F.array())) > 0)
    one = chapters.select("chapter_id", "base", "hash", F.when(small, "data-saver").otherwise("data").alias("tier"), F.posexplode(F.when(small, F.col("small")).otherwise(F.col("full"))).alias("idx", "file"))
    return one.select("chapter_id", "idx", F.concat_ws("/", "base", "tier", "hash", "file").alias("url"))


def is_pending(tl: Column) -> Column:
    return F.trim(F.coalesce(tl, F.lit(""))).isin("", BLANK)


def drawable(regions: DataFrame, erase_only: bool = False, skip: tuple[str, ...] = ("sfx",)) -> DataFrame:
    return regions.where(~F.col("t").isin(*skip) & (F.lit(erase_only) | ~is_pending(F.col("tl"))))


def page_signature(regions: DataFrame) -> DataFrame:
    """(chapter_id, page_idx, signature): number of regions, a bar, their trimmed texts in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("region_id", F.trim(F.coalesce("text", F.lit(""))).alias("text")))), lambda x: x["text"])
    return regions.groupBy("chapter_id", "page_idx").agg(F.concat(F.count("*").cast("string"), F.lit("|"), F.array_join(texts, SEPARATOR)).alias("signature"))


def fresh_drafts(drafts: DataFrame, base: DataFrame) -> DataFrame:
    """drafts with `fresh`: their signature is the page's own, or they have none."""
    now = page_signature(base).withColumnRenamed("signature", "now")
    return drafts.join(now, ["chapter_id", "page_idx"], "left").withColumn("fresh", F.coalesce(F.col("signature") == F.col("now"), F.col("signature").isNull())).drop("now")


def effective_regions(base: DataFrame, drafts: DataFrame, check_signature: bool = True) -> DataFrame:
    """Regions of a page: its draft's live ones where it has a draft (all deleted: none), else the base's."""
    if check_signature:
        drafts = fresh_drafts(drafts, base).where("fresh")
    page = ["chapter_id", "page_idx"]
    columns = [*page, "region_id", "text", "tl"]
    live = drafts.where("NOT coalesce(deleted, false)").select(*columns, F.lit("draft").alias("origin"))
    return base.join(drafts.select(*page).distinct(), page, "left_anti").select(*columns, F.lit("base").alias("origin")).union(live)


def retain_ttl(cache: DataFrame, now: Column, days: int, version: int, target: str | None = None) -> DataFrame:
    """Rows of the current version that are at most `days` old; with `target` only those translated into it: a
    chapter that is cached in another language, or in none, is a miss."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("saved_at").cast("timestamp"))
    live = cache.where((F.col("v") >= version) & (age <= days * 86400))
    return live if target is None else live.where(F.col("target_lang") == target)


def retain_newest(table: DataFrame, cap: int, key: str, *order: str) -> DataFrame:
    """The newest cap rows of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return table.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def chapter_list(regions: DataFrame, chapters: DataFrame) -> DataFrame:
    """For each cached chapter with an entry in chapters(chapter_id, title, chapter, chapter_title, source_lang,
    target_lang, manga_id) its pages, pages with a translation, when it was saved and what it is called,
    newest first. Chapters without an entry, or entries without pages, are partial and left out."""
    pages = regions.groupBy("chapter_id", "page_idx").agg(F.max("saved_at").alias("saved_at"), F.bool_or(~is_pending(F.col("tl"))).alias("told"))
    kept = pages.groupBy("chapter_id").agg(F.count("*").alias("pages"), F.count_if("told").alias("told_pages"), F.max("saved_at").alias("saved_at"))
    given = lambda c, default: F.when(F.coalesce(c, F.lit("")) == "", default).otherwise(F.col(c)).alias(c)
    named = chapters.select("chapter_id", given("title", "Unknown Manga"), given("chapter", "?"), given("chapter_title", ""), given("source_lang", ""), given("target_lang", ""), "manga_id")
    return kept.join(named, "chapter_id").orderBy(F.desc("saved_at"), "chapter_id")


def cache_stats(regions: DataFrame) -> DataFrame:
    return regions.agg(F.countDistinct("chapter_id").alias("entries"), F.sum(2 * (F.length(F.coalesce("text", F.lit(""))) + F.length(F.coalesce("tl", F.lit(""))))).alias("bytes"))


def export_manifest(regions: DataFrame) -> DataFrame:
    """One row a page: the chapter's folder, in which page numbers don't collide with others', file name, regions to
    draw, what is done with it."""
    n = F.count_if(~is_pending(F.col("tl")) & (F.col("t") != "sfx"))
    pages = regions.groupBy("chapter_id", "page_idx").agg(n.alias("regions"))
    folder = safe_name(F.concat(F.lit("Chapter "), F.col("chapter_id").cast("string")))
    name = F.concat(folder, F.lit("_"), F.lpad((F.col("page_idx") + 1).cast("string"), 3, "0"), F.lit(".png"))
    return pages.select("*", folder.alias("folder"), name.alias("file"), F.when(F.col("regions") > 0, "typeset").otherwise("original").alias("action"))


def export_status(manifest: DataFrame, fetched: DataFrame) -> DataFrame:
    """(chapter_id, folder, pages, status, error) of a run over all chapters, from fetched(chapter_id, page_idx, error):
    a chapter ends at its first page with an error, which is told; others go on, and are done where all
    their pages are there, else open."""
    met = manifest.join(fetched.select("chapter_id", "page_idx", F.lit(True).alias("there"), "error"), ["chapter_id", "page_idx"], "left")
    told = met.groupBy("chapter_id", "folder").agg(F.count("*").alias("pages"), F.bool_and(F.coalesce("there", F.lit(False))).alias("whole"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page_idx"))).alias("error"))
    return told.select("chapter_id", "folder", "pages", F.when(F.col("error").isNotNull(), "error").when(F.col("whole"), "done").otherwise("open").alias("status"), "error")


def nearest_context(regions: DataFrame, k: int = 8) -> DataFrame:
    """(…, region_id, context): the k nearest other translated regions of the page by |cy|, in (cy, cx) order.

    Regions of one height are a group that knows its first k + 1 and those of the k groups before and the
    k + 1 after it, in one sort of the page: what is nearest is among them, and regions meet their
    group by height, not each other. Regions without a height neither have a context nor are in one."""
    page = ["chapter_id", "page_idx"]
    told = regions.where(~is_pending(F.col("tl")) & (F.trim("tl") != "-") & F.col("cy").isNotNull())
    groups = told.groupBy(*page, "cy").agg(F.slice(F.array_sort(F.collect_list(F.struct("cy", "cx", "region_id", "tl"))), 1, k + 1).alias("own"))
    down = Window.partitionBy(*page).orderBy("cy")
    around = groups.select(*page, "cy", F.flatten(F.collect_list("own").over(down.rowsBetween(-k, k + 1))).alias("near"))
    asked = regions.where("cy IS NOT NULL").select(*page, "cy").distinct().withColumn("near", F.lit(None).cast(around.schema["near"].dataType)).withColumn("asked", F.lit(1))
    both = around.withColumn("asked", F.lit(0)).unionByName(asked)
    whole = Window.partitionBy(*page).orderBy("cy", "asked")
    before = F.last("near", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("near", ignorenulls=True).over(whole.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("near", F.coalesce(before, after)).where("asked = 1").drop("asked")
    others = F.filter("near", lambda x: x["region_id"] != F.col("region_id"))
    far = F.transform(others, lambda x: F.struct(F.abs(x["cy"] - F.col("cy")).alias("far"), x["cy"].alias("cy"), x["cx"].alias("cx"), x["region_id"].alias("region_id"), x["tl"].alias("tl")))
    best = F.array_sort(F.transform(F.slice(F.array_sort(far), 1, k), lambda x: F.struct(x["cy"].alias("cy"), x["cx"].alias("cx"), x["region_id"].alias("region_id"), x["tl"].alias("tl"))))
    some = (F.size("near") > 1) | (F.col("near")[0]["region_id"] != F.col("region_id"))
    met = regions.select(*page, "region_id", "cy").join(found, [*page, "cy"]).where(some)
    return met.select(*page, "region_id", F.transform(best, lambda x: x["tl"]).alias("context"))


def legend(regions: DataFrame, outside: Column) -> DataFrame:
    """Running number over the page's boxes that are outside and have text."""
    kept = regions.where(outside & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return kept.withColumn("number", F.row_number().over(Window.partitionBy("chapter_id", "page_idx").orderBy("region_id")))


def seed_boxes(regions: DataFrame) -> DataFrame:
    """Editable boxes: the translation if real; the source text only where there is none."""
    told = ~is_pending(F.col("tl"))
    return regions.select("chapter_id", "page_idx", "region_id", F.when(told, F.col("tl")).otherwise("").alias("tl"), F.when(told, "").otherwise(F.col("text")).alias("text"))


def route_pages(pages: DataFrame, target: str, hard: tuple[str, ...], mode: str = "smart", has_key: bool = True) -> DataFrame:
    """pages with route: skip (already in the target language), cached, vision or local. Vision needs a key; it
    takes all pages in mode `all`, hard scripts in mode `smart`, none in mode `off`."""
    base = F.split_part("lang", F.lit("-"), F.lit(1))
    seen = F.lit(has_key and mode != "off") & (F.lit(mode == "all") | F.col("lang").isin(*hard) | base.isin(*hard))
    return pages.withColumn("route", F.when(base == target, "skip").when(F.col("cached"), "cached").when(seen, "vision").otherwise("local"))


def status_summary(items: DataFrame, spend: DataFrame, budget: float) -> DataFrame:
    """For each chapter items by status, what was spent of spend(chapter_id, cost), and whether that
    reached the budget (0: none)."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = items.groupBy("chapter_id").agg(is_("done").alias("done"), is_("error").alias("error"), is_("skipped").alias("skipped"), is_("pending", "working").alias("open"))
    spent = spend.groupBy("chapter_id").agg(F.sum("cost").alias("spent"))
    told = counts.join(spent, "chapter_id", "left").withColumn("spent", F.coalesce("spent", F.lit(0.0)))
    return told.withColumn("over", F.lit(budget > 0) & (F.round("spent", 9) >= budget))


def progress_pct(idx: Column, n: Column) -> Column:
    return F.when(n > 1, F.round((idx + 1) * 100 / n).cast("int"))


def recent(history: DataFrame, now: Column, n: int = 8, version: int = 1) -> DataFrame:
    """The n chapters last read of all, with progress in percent and as text, and how long ago that was.
    Rows of an older version or without a page are no entries."""
    order = F.struct("ts", "event_id")
    valid = history.where((F.coalesce("v", F.lit(1)) >= version) & F.col("page_idx").isNotNull())
    last = valid.groupBy("chapter_id").agg(F.max("ts").alias("ts"), F.max_by("page_idx", order).alias("page_idx"), F.max_by("page_count", order).alias("page_count"))
    pct = progress_pct(F.col("page_idx"), F.col("page_count"))
    label = F.when(pct.isNotNull(), F.format_string("page %d/%d (%d%%)", F.col("page_idx") + 1, F.col("page_count"), pct)).otherwise("")
    return last.select("*", pct.alias("pct"), label.alias("progress"), fmt_ago(F.col("ts"), now).alias("ago")).orderBy(F.desc("ts"), "chapter_id").limit(n)


def latest(history: DataFrame, now: Column, version: int = 1) -> DataFrame:
    """The one chapter last read."""
    return recent(history, now, 1, version)


def dominant_page(views: DataFrame) -> DataFrame:
    """For each observation (reader, hour) the page with the greatest visible share above 0."""
    return views.where("visible > 0").groupBy("reader_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour")).agg(F.max_by("page_idx", F.struct("visible", -F.col("event_id"))).alias("page_idx"))


def resolve_choice(pages: DataFrame, overrides: DataFrame, picks: DataFrame, default: str) -> DataFrame:
    """pages with engine: the chapter's override, else the language's pick, else the default."""
    return pages.join(overrides, "chapter_id", "left").join(F.broadcast(picks), "lang", "left").select(*pages.columns, F.coalesce("override", "picked", F.lit(default)).alias("engine"))
