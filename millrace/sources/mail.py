"""Job alert mails: messages, their bodies, and the cards within them."""

from __future__ import annotations

import itertools
import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.dates import relative_day
from millrace.functions.html import tree_of
from millrace.functions.location import Gazetteer, city_key, located
from millrace.functions.text import bound, company_key, lookup, seniority, squeeze, title_key, with_computed
from millrace.functions.urls import unwrap_tracking

DEEPEST = 8
MOST_BODY_BYTES = 2 * 1024 * 1024
LOOKBACK_HOURS = 26

_PARTS = "array<struct<path:array<int>,part:variant>>"


def _text(value: Column, path: str) -> Column:
    """The text at a path of a variant, null where there is something else."""
    return bound(F.try_variant_get(value, path, "variant"), lambda found: F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string")))


def decoded_body(data: Column) -> Column:
    """A base64url body as text, malformed characters replaced; null where it is too large or isn't any."""

    def text(plain: Column) -> Column:
        short = F.length(plain) % 4
        padded = F.concat(plain, F.when(short == 2, "==").when(short == 3, "=").otherwise(""))
        return F.when(short != 1, F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))

    def checked(given: Column) -> Column:
        plain = F.regexp_replace(F.translate(given, "-_", "+/"), "[^A-Za-z0-9+/]", "")
        return F.when((given != "") & (F.floor(F.length(given) * 3 / 4) <= MOST_BODY_BYTES), bound(plain, text))

    return bound(data, checked)


def parts_of(payload: Column) -> Column:
    """All parts of a message to a bounded depth, each with its path, whose order is that of a walk from the top."""
    nothing = F.array().cast(_PARTS)

    def below(level: Column) -> Column:
        children = lambda x: F.coalesce(F.try_variant_get(x["part"], "$.parts", "array<variant>"), F.array().cast("array<variant>"))
        return F.flatten(F.transform(level, lambda x: F.transform(children(x), lambda part, i: F.struct(F.concat(x["path"], F.array(i)).alias("path"), part.alias("part")))))

    def step(so_far: Column, _: Column) -> Column:
        return F.transform(F.array(below(so_far["last"])), lambda level: F.struct(F.concat(so_far["all"], level).alias("all"), level.alias("last")))[0]

    top = F.array(F.struct(F.array().cast("array<int>").alias("path"), payload.alias("part"))).cast(_PARTS)
    start = F.struct(top.alias("all"), top.alias("last"))
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(DEEPEST)), start, step)["all"], nothing)


def _body(parts: Column, kind: str) -> Column:
    """The first text of a kind that can be decoded."""
    own = F.filter(parts, lambda x: F.lower(_text(x["part"], "$.mimeType")) == kind)
    texts = F.transform(own, lambda x: F.struct(x["path"].alias("path"), decoded_body(_text(x["part"], "$.body.data")).alias("text")))
    return F.array_min(F.filter(texts, lambda x: x["text"].isNotNull()))["text"]


def _header(payload: Column, name: str) -> Column:
    headers = F.coalesce(F.try_variant_get(payload, "$.headers", "array<variant>"), F.array().cast("array<variant>"))
    values = F.transform(F.filter(headers, lambda h: F.lower(_text(h, "$.name")) == name), lambda h: _text(h, "$.value"))
    return F.get(F.array_compact(values), F.lit(0))


def address(header: Column) -> Column:
    """The address of a sender's header: what is in angle brackets, else all of it but comments."""
    return F.trim(F.coalesce(F.nullif(F.regexp_extract(header, r"<([^<>]*)>", 1), F.lit("")), F.regexp_replace(header, r"\([^)]*\)", "")))


def parsed(landed: DataFrame, column: str = "value") -> DataFrame:
    """message_id, sender, subject, millis, html_body, text_body of message resources; rows without id, sender or time are left out.

    The tree of parts is a variant, walked level by level in the JVM.
    """
    given = with_computed(landed.select(column), "m", F.try_parse_json(F.col(column)))
    millis = F.coalesce(F.try_variant_get("m", "$.internalDate", "string"), F.lit(""))
    rows = given.select("m", F.try_variant_get("m", "$.payload", "variant").alias("payload"), millis.alias("millis"), F.try_variant_get("m", "$.id", "string").alias("message_id"))
    rows = rows.select("message_id", address(_header(F.col("payload"), "from")).alias("sender"), F.coalesce(_header(F.col("payload"), "subject"), F.lit("")).alias("subject"), "millis", parts_of(F.col("payload")).alias("parts"))
    rows = rows.filter((F.col("message_id") != "") & (F.col("sender") != "") & F.col("millis").rlike(r"^-?\d+$"))
    return rows.select("message_id", "sender", "subject", "millis", _body(F.col("parts"), "text/html").alias("html_body"), _body(F.col("parts"), "text/plain").alias("text_body"))


def messages(landed: DataFrame, senders: list[str], since: Column, column: str = "value") -> DataFrame:
    """message_id, sender, subject, received_at, html_body, text_body of allowed senders.

    No senders allow nothing.
    """
    rows = parsed(landed, column)
    rows = rows.withColumn("received_at", F.timestamp_millis(F.col("millis").cast("long"))).drop("millis")
    allowed = [s.strip().lower() for s in senders if s.strip()]
    return rows.filter(F.lower("sender").isin(allowed) & (F.col("received_at") >= since))


def search_query(label: str, senders: list[str], since_epoch: int) -> str:
    """What the landing job asks the mailbox for."""
    terms = [f'label:"{label}"'] if label else []
    if senders:
        terms.append(f"from:({' OR '.join(senders)})")
    return " ".join([*terms, f"after:{since_epoch}"])


def read_messages(spark: SparkSession, path: str, senders: list[str], since: Column) -> DataFrame:
    """Messages of a landing folder with one JSON resource per line."""
    return messages(spark.read.text(path), senders, since)


# -- cards

# Which links are jobs, and where their keys are, by platform.
PLATFORMS = {
    "linkedin": (r"linkedin\.com/(?:comm/)?jobs/view/", r"/jobs/view/(\d+)", "linkedin_job_id"),
    "indeed": (r"(?:cts\.)?indeed\.com/(?:v\d+/[^\s\"']*|rc/clk|pagead/clk|viewjob)", r"[?&](?:jk|vjk)=([0-9a-f]{8,})", "indeed_job_key"),
    "naukri": (r"naukri\.com/(?:job-listings|jobs)[-/]|naukri\.com/trkweb|jobseeker/.*jobid", r"(?:job-listings-[a-z0-9-]*?|jobid[=/])([0-9]{6,})", "naukri_job_id"),
}
# Lines of a card that say nothing about the job.
NOISE = (
    r"easy apply|actively hiring|be an early applicant|promoted|viewed|new|apply now|view job|see job|saved? job|be one of the first|actively recruiting|"
    r"\d[\d,]*\s+(?:applicants?|connections?|alumni)\b.*|\d+\s*[-–]\s*\d+\s*(?:yrs?|years?)\b.*|not disclosed.*|₹.*|rs\.?\s*\d.*|\$\s*[\d,]+.*|posted\b.*|"
    r"\d+\+?\s*(?:minute|hour|day|week|month)s?\s+ago\b.*|just (?:now|posted)|today|yesterday"
)
HINT = r"(?i)\b(today|yesterday|just (?:now|posted)|\d+\+?\s*(?:minute|hour|day|week|month)s?\s+ago)\b"
EXPERIENCE = r"(?i)\b(\d+\s*[-–]\s*\d+)\s*(?:yrs?|years?)\b"
SNIPPET_CHARS = 40
#: Elements that a card can be, how many lines it has at least, and how far above its link it can be.
CARD_ELEMENTS = ("tr", "table", "li")
CARD_LINES = 2
CARD_LEVELS = 6


def platform_of(sender: Column) -> Column:
    """Platform whose alerts a sender's address belongs to."""
    lowered = F.lower(sender)
    return F.coalesce(*(F.when(F.contains(lowered, F.lit(name)), F.lit(name)) for name in PLATFORMS))


_LEVELS = "array<struct<tag:string,text:string,plain:string>>"


def _without_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text)) if not unicodedata.combining(c))


@F.udtf(returnType=f"card int, title string, href string, levels {_LEVELS}")
class Links:
    """The links of a mail whose address matches, with the elements above them and all their text, also without accents."""

    def eval(self, body: str, pattern: str):
        if not body or not pattern:
            return
        wanted = re.compile(pattern, re.IGNORECASE)
        for number, link in enumerate(e for e in tree_of(body) if e.tag == "a" and wanted.search(e.attributes.get("href", ""))):
            above = itertools.islice(itertools.takewhile(lambda e: e is not None, link.ancestors()), CARD_LEVELS)
            yield number, link.text(" "), link.attributes["href"], [(e.tag, text, _without_accents(text)) for e in above for text in [e.text("\n")]]


def card_lines(levels: Column, title: Column) -> Column:
    """Lines (struct of line, plain) of the card around a title: of the element with the most, up to the first that is a card.

    Of elements with as many lines the innermost counts.
    """

    def lines(level: Column) -> Column:
        both = F.zip_with(F.split(level["text"], "\n"), F.split(level["plain"], "\n"), lambda line, plain: F.struct(squeeze(line).alias("line"), plain.alias("plain")))
        return F.filter(both, lambda x: (x["line"] != "") & (x["line"] != title))

    def chosen(given: Column) -> Column:
        sizes = F.transform(given, lambda level: F.size(level["lines"]))
        most = lambda i: F.array_max(F.slice(sizes, F.lit(1), i + 1))
        ends = F.filter(F.transform(given, lambda level, i: F.when(level["tag"].isin(*CARD_ELEMENTS) & (most(i) >= CARD_LINES), i)), lambda i: i.isNotNull())
        last = F.coalesce(F.try_element_at(ends, F.lit(1)), F.size(given) - 1)
        return F.try_element_at(given, F.array_position(sizes, most(last)).cast("int"))["lines"]

    return bound(F.transform(levels, lambda level: F.struct(level["tag"].alias("tag"), lines(level).alias("lines"))), chosen)


def card_parts(lines: Column, gazetteer: Gazetteer | None = None) -> Column:
    """struct(company_name, location_raw, location_plain, snippet) of a card's lines (struct of line, plain).

    Lines are numbered, and those that say something ranked by what they look
    like: the first is the company, the first later one that is a place the
    place, the first long one besides the snippet, and without a place the first
    other line stands for it.
    """
    names = gazetteer or Gazetteer()

    def looks(line: Column) -> Column:
        place = located(line["plain"], names)
        return place["city"].isNotNull() | place["country"].isNotNull() | place["is_remote"]

    def first(rows: Column, test) -> Column:
        return F.try_element_at(F.filter(rows, test), F.lit(1))

    def parts(telling: Column) -> Column:
        company, later = F.try_element_at(telling, F.lit(1)), F.slice(telling, F.lit(2), F.greatest(F.size(telling) - 1, F.lit(0)))

        def with_place(place: Column) -> Column:
            snippet = first(later, lambda t: ~t["at"].eqNullSafe(place["at"]) & (F.length(t["line"]) >= SNIPPET_CHARS))
            other = first(later, lambda t: ~t["at"].eqNullSafe(place["at"]) & ~t["at"].eqNullSafe(snippet["at"]))
            return F.struct(company["line"].alias("company_name"), F.coalesce(place["line"], other["line"]).alias("location_raw"), F.coalesce(place["plain"], other["plain"]).alias("location_plain"), snippet["line"].alias("snippet"))

        return bound(first(later, looks), with_place)

    numbered = F.transform(lines, lambda pair, i: F.struct(i.alias("at"), pair["line"].alias("line"), pair["plain"].alias("plain")))
    return bound(F.filter(numbered, lambda t: ~t["line"].rlike(rf"(?i)^(?:{NOISE})\s*$")), parts)


def cards(mails: DataFrame, gazetteer: Gazetteer | None = None) -> DataFrame:
    """The mails' columns and platform, title, company_name, location_raw, snippet, posted_hint, source_url,
    canonical_url, unwrapped, extra, location_plain: one row for each title link of a platform with what stands around it.
    """
    of = lambda i: lookup(F.col("platform"), {name: parts[i] for name, parts in PLATFORMS.items()})
    rows = mails.withColumn("platform", platform_of(F.col("sender"))).withColumn("_pattern", of(0))
    rows = rows.lateralJoin(Links(F.col("html_body").outer(), F.col("_pattern").outer())).withColumn("title", squeeze(F.col("title")))
    rows = with_computed(rows, "_lines", card_lines(F.col("levels"), F.col("title"))).drop("levels")
    rows = with_computed(rows, "_parts", card_parts(F.col("_lines"), gazetteer)).select("*", "_parts.*")
    rows = rows.filter("title <> '' and company_name is not null")

    def found(pattern: str, group: int) -> Column:
        return F.try_element_at(F.filter(F.transform("_lines", lambda x: F.regexp_extract(x["line"], pattern, group)), lambda x: x != ""), F.lit(1))

    key = F.coalesce(*(F.when(F.col("platform") == name, F.regexp_extract("href", f"(?i){parts[1]}", 1)) for name, parts in PLATFORMS.items()))
    years = F.when(F.col("platform") == "naukri", F.replace(found(EXPERIENCE, 1), F.lit(" "), F.lit("")))
    extra = F.map_filter(F.map_from_arrays(F.array(of(2), F.lit("experience_hint")), F.array(F.nullif(key, F.lit("")), years)), lambda _, v: v.isNotNull())
    rows = rows.withColumn("posted_hint", found(HINT, 0)).withColumn("extra", extra).withColumn("_link", unwrap_tracking(F.col("href")))
    return rows.withColumn("source_url", F.col("href")).withColumn("canonical_url", F.col("_link.url")).withColumn("unwrapped", F.col("_link.unwrapped")).drop("_pattern", "_lines", "_parts", "_link", "href", "card")


def external_id(platform: Column, company: Column, title: Column, place: Column) -> Column:
    """A key for postings that have none: platform, company, title and place normalised."""
    return F.left(F.sha2(F.concat_ws("|", F.lower(F.trim(platform)), company, title, place), 256), F.lit(32))


def leads(mails: DataFrame, source_id: int, gazetteer: Gazetteer | None = None) -> DataFrame:
    """Postings out of mails: one for each different job, low in detail.

    Of a job in several mails the newest mail counts.
    """
    found = cards(mails, gazetteer).withColumn("_place", located(F.coalesce("location_plain", F.lit("")), gazetteer or Gazetteer()))
    key = external_id(F.col("platform"), company_key(F.col("company_name")), title_key(F.col("title")), city_key(F.col("_place.city"), F.col("_place.is_remote"), F.col("location_raw")))
    found = found.withColumn("external_id", key)
    newest = F.row_number().over(Window.partitionBy("external_id").orderBy(F.desc("received_at"), "message_id"))
    found = found.withColumn("_r", newest).filter("_r = 1")
    stub = F.concat_ws(
        "\n",
        F.concat(F.lit("Discovered via "), F.col("platform"), F.lit(" job alert email received "), F.date_format("received_at", "yyyy-MM-dd"), F.lit(".")),
        F.concat(F.lit("Title: "), F.col("title")), F.concat(F.lit("Company: "), F.col("company_name")),
        F.concat(F.lit("Location: "), F.coalesce(F.nullif("location_raw", F.lit("")), F.lit("not stated"))),
        F.concat(F.lit("Snippet: "), F.nullif("snippet", F.lit(""))),
        F.lit("No job description available from this source. Open the posting to read it."),
    )
    raw = F.map_concat(
        F.create_map(
            F.lit("fidelity"), F.lit("low"), F.lit("snippet_only"), F.lit("true"), F.lit("needs_description"), F.lit("true"), F.lit("platform"), F.col("platform"), F.lit("email_message_id"), F.col("message_id"),
            F.lit("email_sender"), F.col("sender"), F.lit("company_name"), F.col("company_name"), F.lit("snippet"), F.col("snippet"), F.lit("posted_hint"), F.col("posted_hint"), F.lit("source_url"), F.col("source_url"),
            F.lit("canonical_url_source"), F.when(F.col("unwrapped"), F.lit("unwrapped_offline")).otherwise(F.lit("tracking_url_retained")),
        ),
        F.coalesce("extra", F.create_map().cast("map<string,string>")),
    )
    return found.select(
        F.lit(source_id).alias("source_id"), "external_id", F.col("canonical_url").alias("url"), "title", F.lit(None).cast("string").alias("description_html"), stub.alias("description_text"),
        F.lit(None).cast("string").alias("department"), "location_raw", F.col("_place.city").alias("location_city"), F.col("_place.country").alias("location_country"),
        F.coalesce(F.col("_place.is_remote"), F.lit(False)).alias("is_remote"), F.lit("unknown").alias("employment_type"), seniority(F.col("title")).alias("seniority_guess"),
        posted_at(F.col("posted_hint"), F.col("received_at")).alias("posted_at"), F.to_json(raw).alias("raw"), "company_name",
    )


def posted_at(hint: Column, received: Column) -> Column:
    """The day that a hint means, seen from when the mail came."""
    soon = hint.rlike(r"(?i)just (?:now|posted)|\b\d+\+?\s*(?:minute|hour)s?\s+ago\b")
    return relative_day(F.concat(F.lit("posted "), F.when(soon, F.lit("today")).otherwise(F.trim(hint))), received)


def parse_misses(mails: DataFrame, gazetteer: Gazetteer | None = None) -> DataFrame:
    """message_id, sender of mails that no card was found in."""
    return mails.join(cards(mails, gazetteer).select("message_id").distinct(), "message_id", "left_anti").select("message_id", "sender")
