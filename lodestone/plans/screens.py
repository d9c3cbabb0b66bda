"""Queries over screening, full-text classification, landing pages and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.regexes import rounded
from lodestone.functions.rules import ScreenPack
from lodestone.functions.text import clean_text
from lodestone.functions.markup import Attr, Selector
from lodestone.operators import acquisition, fulltext, logs, numbering, screening
from lodestone.operators.evaluation import prf
from lodestone.operators.shared import scratch
from lodestone.plans.corpus import table, texts

QUERIES, ORACLES = {}, {}

#: A rule pack whose words occur in the documents at hand.
PACK = ScreenPack(
    name="License", symbol="Li", metal="licensed under", other_metal="all rights",
    signals=(("copyright", 20, "copyright wording"), ("version", 20, "version"), ("token", 20, "token wording"), ("the", 15, "english wording")),
    h2="token", review="rights reserved", exclusions=("mail", "key", "555-"),
)

_RECORDS = "select doc_id, array_to_string(list_slice(string_split(text, ' '), 1, 8), ' ') as title, text as abstract, case doc_id % 3 when 0 then 'primary' when 1 then 'unknown' else '' end as record_type from documents"


def _records(spark: SparkSession, d: str) -> DataFrame:
    title = F.array_join(F.slice(F.split("text", " ", 9), 1, 8), " ")
    kind = F.when(F.col("doc_id") % 3 == 0, "primary").when(F.col("doc_id") % 3 == 1, "unknown").otherwise("")
    return texts(spark, d, "documents").select("doc_id", title.alias("title"), F.col("text").alias("abstract"), kind.alias("record_type"))


def _sig() -> str:
    return " + ".join(f"case when t like '%{p}%' then {n} else 0 end" for p, n, _ in PACK.all_signals())


_MISS = "concat_ws(', ', " + ", ".join(f"case when t not like '%{p}%' then '{label}' end" for p, _, label in PACK.all_signals()) + ")"
_VETO = "case " + " ".join(f"when t like '%{x}%' then '{x}'" for x in PACK.exclusions) + " end"
SCREENED = f"""
select doc_id, kind as record_type,
 case when veto is not null then 'Exclude' when kind = 'review' then 'Review source - citation mining' when score = 100 then 'Include - metadata supports criteria; manual verification required' else 'Primary candidate - manual review required' end as inclusion_decision,
 case when veto is not null then upper(substr(veto, 1, 1)) || lower(substr(veto, 2)) when kind = 'review' then 'Review excluded from final primary-paper dataset' when score = 100 then '' else 'Not explicit in searchable metadata: ' || miss end as exclusion_reason,
 cast(score as varchar) as confidence_score, case when t like '%token%' then 'token' else '' end as h2_evidence,
 case when (veto is null and kind <> 'review' and score = 100) or score >= 80 then 'Tier 1' else 'Tier 2' end as tier
from (select doc_id, t, {_sig()} as score, {_MISS} as miss, {_VETO} as veto, case when t like '%rights reserved%' then 'review' else coalesce(nullif(record_type, ''), 'unknown') end as kind
 from (select *, lower(title || ' ' || abstract) as t from ({_RECORDS}) r) q) s"""


def title_abstract_screen(spark: SparkSession, d: str) -> DataFrame:
    return screening.screen(_records(spark, d), PACK).select("doc_id", "record_type", "inclusion_decision", "exclusion_reason", "confidence_score", "h2_evidence", "tier")


QUERIES["title_abstract_screen"], ORACLES["title_abstract_screen"] = title_abstract_screen, SCREENED
QUERIES["screen_counts"] = lambda spark, d: title_abstract_screen(spark, d).groupBy("inclusion_decision", "tier").agg(F.count("*").alias("n"))
ORACLES["screen_counts"] = f"select inclusion_decision, tier, count(*) as n from ({SCREENED}) s group by 1, 2"
QUERIES["strict_filter"] = lambda spark, d: screening.strict(screening.screen(_records(spark, d), PACK)).select("doc_id", "h2_evidence", "strict_decision")
ORACLES["strict_filter"] = f"select doc_id, h2_evidence, 'Include in H2-only dataset - explicit H2 evidence in metadata' as strict_decision from ({SCREENED}) s where inclusion_decision <> 'Exclude' and h2_evidence <> ''"


def screen_sheets(spark: SparkSession, d: str) -> DataFrame:
    s = screening.sheets(title_abstract_screen(spark, d))
    out = None
    for name, part in s.items():
        one = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("sheet"), "n")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["screen_sheets"] = screen_sheets
ORACLES["screen_sheets"] = f"with s as ({SCREENED}) select 'included' as sheet, count(*) as n from s where inclusion_decision like 'Include%' union all select 'reviews', count(*) from s where record_type = 'review' union all select 'excluded', count(*) from s where inclusion_decision = 'Exclude'"


def screening_prf(spark: SparkSession, d: str) -> DataFrame:
    s = title_abstract_screen(spark, d).select("doc_id", (F.col("confidence_score").cast("int") >= 15).alias("said"))
    j = s.join(table(spark, d, "labels"), "doc_id").select((F.col("quality") == 1).alias("truth"), "said")
    return prf(j, "truth", "said").select("tp", "fp", "fn", "tn", *[rounded(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")])


QUERIES["screening_prf"] = screening_prf
ORACLES["screening_prf"] = f"""
select tp, fp, fn, tn, cast(printf('%.4f', tp / (tp + fp)) as double) as precision, cast(printf('%.4f', tp / (tp + fn)) as double) as recall, cast(printf('%.4f', 2 * tp / (2 * tp + fp + fn)) as double) as f1 from
 (select count(*) filter (t and s) as tp, count(*) filter (not t and s) as fp, count(*) filter (t and not s) as fn, count(*) filter (not t and not s) as tn from
  (select quality = 1 as t, cast(confidence_score as int) >= 15 as s from ({SCREENED}) a join labels using (doc_id)) b) c"""

#: A full-text pack over conversations: conv_id is the paper, turn its page.
FULL = fulltext.FullTextPack(name="English", metal="the", other_metal="rrrr", asymmetric="and", hydrogenation="ing", h2="ed", scope="tion", table="of [a-z]+", ee=("er of", "is"), review="qqqq", non_primary="aaaa", exclusions=(("long", "ouea"), ("loud", "hehe")))


def _papers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = texts(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_no"), "text")
    papers = pages.groupBy("doc_id").agg(F.substring(F.min(F.struct("page_no", "text"))["text"], 1, 60).alias("title")).withColumns({"has_pdf": F.col("doc_id") % 11 != 0, "error": F.when(F.col("doc_id") % 13 == 0, "broken file")})
    return papers, pages


QUERIES["fulltext_classify"] = lambda spark, d: fulltext.classify(*_papers(spark, d), FULL).select("doc_id", "classification", "decision_reason", "hydrogen_source", "ee_value", "pages_used", "exclusion_keywords")
_PAGES = "select conv_id as doc_id, cast(turn + 1 as int) as page_no, text from conversations"


def _first_page(pattern: str) -> str:
    return f"min(struct_pack(page := page_no, m := regexp_extract(text, '{pattern}', 0, 'i'))) filter (regexp_matches(text, '(?i){pattern}'))"


QUERIES["first_page_match"] = lambda spark, d: fulltext.first_on_pages(_papers(spark, d)[1], {"h": ("ed",), "e": ("er of", "is")}).select("doc_id", F.col("h.page").alias("h_page"), F.col("h.match").alias("h"), F.col("e.page").alias("e_page"), F.col("e.match").alias("e"))
_EE_SQL = "min(struct_pack(page := page_no, m := case when regexp_matches(text, '(?i)er of') then regexp_extract(text, 'er of', 0, 'i') else regexp_extract(text, 'is', 0, 'i') end)) filter (regexp_matches(text, '(?i)er of|is'))"
ORACLES["first_page_match"] = f"select doc_id, h.page as h_page, h.m as h, e.page as e_page, e.m as e from (select doc_id, {_first_page('ed')} as h, {_EE_SQL} as e from ({_PAGES}) p group by 1) q"

_SENT = r"list_transform(list_filter(regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '.*?[.!?] +|.+$'), lambda x: trim(x) <> ''), lambda x: trim(x))"
_ALL = "regexp_matches({0}, '(?i)the') and regexp_matches({0}, '(?i)ed') and regexp_matches({0}, '(?i)and')"
_ANY = "(regexp_matches({0}, '(?i)the') or regexp_matches({0}, '(?i)ed') or regexp_matches({0}, '(?i)and'))"
QUERIES["evidence_context"] = lambda spark, d: fulltext.evidence(_papers(spark, d)[1], FULL).select("doc_id", F.col("evidence.page").alias("page"), F.col("evidence.sentence").alias("sentence"))
EVIDENCE = f"""
with s as (select doc_id, page_no, text, generate_subscripts(l, 1) as i, unnest(l) as sent from (select *, {_SENT} as l from ({_PAGES}) p) q),
f as (select doc_id, arg_min(struct_pack(page := page_no, sentence := sent), page_no * 100000 + i) filter ({_ALL.format("sent")}) as s3,
 arg_min(struct_pack(page := page_no, sentence := sent), page_no * 100000 + i) filter ({_ALL.format("text")} and {_ANY.format("sent")}) as w3,
 arg_min(struct_pack(page := page_no, sentence := sent), page_no * 100000 + i) filter (regexp_matches(sent, '(?i)ed')) as s1 from s group by 1)
select doc_id, x.page as page, substr(x.sentence, 1, 800) as sentence from (select doc_id, coalesce(s3, w3, s1) as x from f) y"""
ORACLES["evidence_context"] = EVIDENCE

ORACLES["fulltext_classify"] = f"""
with ev as ({EVIDENCE}),
g as (select doc_id, substr(arg_min(text, page_no), 1, 60) as title, {_first_page("ed")} as h, {_first_page("and")} as a, {_EE_SQL} as e, {_first_page("tion")} as sc,
 concat_ws('; ', case when bool_or(regexp_matches(text, '(?i)ouea')) then 'long' end, case when bool_or(regexp_matches(text, '(?i)hehe')) then 'loud' end) as x from ({_PAGES}) p group by 1),
t as (select g.*, ev.page as ev_page, coalesce(ev.sentence, '') as sentence, g.doc_id % 11 <> 0 as pdf, g.doc_id % 13 = 0 as err, regexp_matches(title, '(?i)the') as tm, regexp_matches(title, '(?i)rrrr') as tother, regexp_matches(title, '(?i)and') as ta, regexp_matches(title, '(?i)ing') as th,
 concat_ws(', ', case when regexp_matches(title, '(?i)ouea') then 'long' end, case when regexp_matches(title, '(?i)hehe') then 'loud' end) as tx from g left join ev using (doc_id)),
r as (select *, case when not pdf then 0 when err then 1 when tx <> '' then 2 when tother and not tm then 3 when not tm and regexp_matches(sentence, '(?i)rrrr') then 4 when tm and th and not ta then 5 when regexp_matches(title, '(?i)aaaa') then 6
 when tm and ta and th and h is not null and e is not null and sc is not null then 7 when regexp_matches(title, '(?i)qqqq') then 8 else 9 end as rule from t)
select doc_id, case when rule in (0, 1, 9) then 'C. Uncertain' when rule = 7 then 'A. Confirmed' else 'B. Excluded' end as classification,
 case rule when 0 then 'No accessible PDF.' when 1 then 'PDF text extraction failed.' when 2 then 'Title: prohibited system (' || tx || ')' when 3 then 'Title identifies non-English catalyst: ' || regexp_extract(title, 'rrrr', 0, 'i')
 when 4 then 'H2 evidence sentence identifies non-English catalyst: ' || regexp_extract(sentence, 'rrrr', 0, 'i') when 5 then 'Title identifies English-catalysed hydrogenation but not asymmetric.' when 6 then 'Non-primary record (review/ML/HTE).'
 when 7 then 'Full text explicitly supports English catalyst, molecular H2, asymmetric reaction, ee value, and experimental substrate scope.' when 8 then 'Review or chapter.'
 else 'Full-text evidence incomplete: ' || concat_ws(', ', case when not tm then 'English catalyst' end, case when h is null then 'molecular H2' end, case when not ta then 'asymmetric reaction' end, case when e is null then 'ee value' end, case when sc is null then 'substrate scope' end) end as decision_reason,
 case when rule < 2 then 'Not verified' else coalesce(h.m, 'Not found') end as hydrogen_source, case when rule < 2 then 'Not verified' else coalesce(e.m, 'Not found') end as ee_value,
 case when rule < 2 then 'Not available' else coalesce(nullif(array_to_string(list_transform(list_filter([ev_page, h.page, a.page, e.page, sc.page], lambda p, i: p is not null and not list_contains(list_slice([ev_page, h.page, a.page, e.page, sc.page], 1, i - 1), p)), lambda p: cast(p as varchar)), ', '), ''), 'Not found') end as pages_used,
 case when rule < 2 then 'Not verified' else coalesce(nullif(x, ''), 'None') end as exclusion_keywords from r"""

_CHALLENGES, _WALLS = (("first", ("casino", "zzzz")), ("second", ("rere", "tion "))), ("thanonth", "que la que")
_LINKS = (Selector("a", (Attr("href", "$", "an"),)), Selector("a", (Attr("href", "*", "CO", True), Attr("href", "*", "n"))), Selector("a", says="de"), Selector("a", matches="(?i)^th"), Selector("a"))
_LOGINS = (Selector("a", (Attr("href", "*", "SCH", True), Attr("href", "*", "e"))), Selector("p", (), (Attr("class", "*", "promo"),)))
QUERIES["page_access_class"] = lambda spark, d: acquisition.page_class(texts(spark, d, "pages"), challenges=_CHALLENGES, walls=_WALLS, links=_LINKS, logins=_LOGINS).select("page_id", "challenge", "login", "paywall", "pdf_link")
_UNESCAPED = "replace(replace(replace(replace({0}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"
_TEXT = "lower(trim(regexp_replace(" + _UNESCAPED.format(r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g')") + r", '<[^>]+>', '', 'g'), e' \t\n\r\f\v'))"
ORACLES["page_access_class"] = f"""
select page_id, case when t like '%casino%' or t like '%zzzz%' then 'first' when t like '%rere%' or t like '%tion %' then 'second' end as challenge, len(list_filter(hrefs, lambda x: x ilike '%sch%' and x like '%e%')) > 0 or regexp_matches(html, '<[a-z]+ class="[^"]*promo') as login, t like '%thanonth%' or t like '%que la que%' as paywall,
 regexp_extract(url, '^https?://[^/]+') || coalesce(list_filter(l, lambda x: not regexp_matches(lower(x), 'suppl_file|suppl/|supplementary|_si_|_si\\.|-si\\.|-si_|supporting_information|supporting-information|supp_|/supp\\.|esm|s1\\.pdf|s2\\.pdf|s3\\.pdf'))[1], l[1]) as pdf_link
from (select *, list_concat(list_filter(hrefs, lambda x: x like '%an'), list_filter(hrefs, lambda x: x ilike '%co%' and x like '%n%'), list_transform(list_filter(list_zip(hrefs, says), lambda x: x[2] = 'de'), lambda x: x[1]), list_transform(list_filter(list_zip(hrefs, says), lambda x: x[2] ilike 'th%'), lambda x: x[1]), hrefs) as l
 from (select page_id, url, {_TEXT} as t, html, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) as hrefs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as says from pages) q) r""".replace("\\\\", "\\")

QUERIES["clean_text"] = lambda spark, d: texts(spark, d, "pages").select("page_id", F.sha2(clean_text(F.col("html")), 256).alias("sha"), F.length(clean_text(F.col("html"))).alias("n"))
_CLEAN = r"trim(regexp_replace(" + _UNESCAPED.format("html") + r", '<[^>]+>', '', 'g'), e' \t\n\r\f\v')"
ORACLES["clean_text"] = f"select page_id, sha256({_CLEAN}) as sha, cast(length({_CLEAN}) as int) as n from pages where not regexp_matches(html, '&am?p?$')  union all select page_id, sha256(regexp_replace({_CLEAN}, '&amp$', '&')), cast(length(regexp_replace({_CLEAN}, '&amp$', '&')) as int) from pages where regexp_matches(html, '&am?p?$')"


def log_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("row"), "event_id", "event_type")
    first = e.groupBy("row").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))
    new = e.where("event_type = 'purchase'").groupBy("row").agg(F.max("event_id").alias("event_id")).withColumn("event_type", F.lit("new"))
    return logs.upsert(first, new)


QUERIES["log_upsert"] = log_upsert
ORACLES["log_upsert"] = """
with n as (select user_id as "row", max(event_id) as event_id, 'new' as event_type from events where event_type = 'purchase' group by 1)
select user_id as "row", min(event_id) as event_id, arg_min(event_type, event_id) as event_type from events where user_id not in (select "row" from n) group by 1 union all select * from n"""

QUERIES["state_latest"] = lambda spark, d: logs.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", F.col("value").alias("status")), ["user_id", "event_type"], "event_id", "status")
ORACLES["state_latest"] = "select user_id, event_type, arg_max(value, event_id) as status, max(event_id) as event_id from events group by 1, 2"


def state_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.element_at(F.array(*map(F.lit, logs.STAGES)), (F.col("event_id") % 5 + 1).cast("int")).alias("stage"), "event_id", F.col("event_type").alias("status"))
    return logs.summary(logs.latest(e, ["run_id", "stage"], "event_id", "status"), e.select("run_id").distinct())


QUERIES["state_summary"] = state_summary
_STAGE = "['" + "', '".join(logs.STAGES) + "']"
ORACLES["state_summary"] = f"""
with e as (select user_id as run_id, {_STAGE}[event_id % 5 + 1] as stage, event_id, event_type from events), l as (select run_id, stage, arg_max(event_type, event_id) as status from e group by 1, 2),
p as (select run_id, cast(generate_subscripts({_STAGE}, 1) - 1 as int) as place, unnest({_STAGE}) as stage from (select distinct run_id from e) q)
select run_id, place, stage, coalesce(status, 'pending') as status from p left join l using (run_id, stage)"""


def download_status(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d, "documents").select(F.col("doc_id").alias("row"), (F.col("doc_id") % 7 == 0).alias("exists"))
    n = (F.col("row") % 4).cast("int")
    attempts = docs.where(n > 0).select("row", F.explode(F.sequence(F.lit(1), n)).alias("ordinal")).withColumns({"url": F.concat(F.lit("https://x/"), "row", F.lit("/"), "ordinal"), "ok": (F.col("row") + F.col("ordinal")) % 3 == 0})
    return acquisition.attempt_status(docs, attempts)


QUERIES["download_status"] = download_status
ORACLES["download_status"] = """
select "row", "exists", case when "exists" then 'REUSED' when n = 0 then 'NO_OA_URL' when won is not null then 'SUCCESS' else 'DOWNLOAD_FAILED' end as status,
 case when not "exists" and n > 0 and won is not null then 'https://x/' || "row" || '/' || won else '' end as url
from (select doc_id as "row", doc_id % 7 = 0 as "exists", doc_id % 4 as n, (select min(k) from range(1, 4) t(k) where k <= doc_id % 4 and (doc_id + k) % 3 = 0) as won from documents) q"""


def log_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The log in its order, each line with its place."""
    e = table(spark, d, "events").select(F.col("user_id").alias("row"), "event_id", "event_type")
    first = e.groupBy("row").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))
    new = e.where("event_type = 'purchase'").groupBy("row").agg(F.max("event_id").alias("event_id")).withColumn("event_type", F.lit("new"))
    return numbering.numbered(logs.upsert(first, new), [F.col("row").asc_nulls_first()], "place", f"{scratch(spark, 'log-sorted')}/sorted", 1)


QUERIES["log_sorted"] = log_sorted
ORACLES["log_sorted"] = f'select *, row_number() over (order by "row" nulls first) as place from ({ORACLES["log_upsert"]}) u'

QUERIES["run_ids"] = lambda spark, d: table(spark, d, "part").select("p_partkey", logs.run_id(F.concat_ws("/", "p_name", "p_type"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("p_partkey") * 61)).alias("run_id"))
ORACLES["run_ids"] = r"""select p_partkey, translate(p_name || '/' || p_type, ' /\', '___') || '_' || strftime(epoch_ms((1700000000 + p_partkey * 61) * 1000), '%Y%m%d_%H%M%S') as run_id from part""".replace("\\\\", "\\")


def _urls(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row"))
    some = lambda name, m: F.transform(F.sequence(F.lit(0), (F.col("row") % m).cast("int")), lambda i: F.when(i % 3 == 2, F.lit("")).otherwise(F.concat(F.lit(name), F.col("row").cast("string"), F.lit("/"), i.cast("string"))))
    return acquisition.attempts_of(docs, {"OpenAlex": some("https://a/", 4), "Crossref": F.when(F.col("row") % 2 == 0, some("https://b/", 3)), "Unpaywall": some("https://a/", 2)})


QUERIES["url_attempts"] = _urls
ORACLES["url_attempts"] = """
with u as (select doc_id as "row", 1 as s, 'OpenAlex' as source, i, 'https://a/' || doc_id || '/' || i as url from documents, range(0, 4) t(i) where i <= doc_id % 4
 union all select doc_id, 2, 'Crossref', i, 'https://b/' || doc_id || '/' || i from documents, range(0, 3) t(i) where i <= doc_id % 3 and doc_id % 2 = 0
 union all select doc_id, 3, 'Unpaywall', i, 'https://a/' || doc_id || '/' || i from documents, range(0, 2) t(i) where i <= doc_id % 2)
select "row", cast(row_number() over (partition by "row" order by s, i) as int) as ordinal, source, url from u where i % 3 <> 2"""


def visit_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    v = table(spark, d, "pages").select(
        "page_id", acquisition.nav_url(F.when(k % 13 == 0, "ftp:/x").when(k % 11 != 0, F.col("url")), F.when(k % 13 == 0, "10.1/x")).alias("nav_url"), (k % 7 == 0).alias("timed_out"), F.when(k % 3 == 0, "captcha").alias("challenge"), (k % 6 == 0).alias("challenge_left"),
        F.when(k % 5 != 1, k % 10 == 0).alias("login_left"), (k % 17 == 0).alias("paywall"), F.col("url").alias("page_url"), F.when(k % 4 != 0, F.concat("url", F.lit(".pdf"))).alias("pdf_link"), F.when(k % 9 != 0, k * 100).alias("file_bytes"),
        F.when(k % 8 != 3, F.when(k % 8 == 5, F.lit(b"<html>")).otherwise(F.lit(b"%PDF-1.7"))).alias("file_head"), F.lit(15_000).alias("min_bytes"),
    )
    return acquisition.visit_status(v).select("page_id", "status", "status_notes")


QUERIES["visit_status"] = visit_status
ORACLES["visit_status"] = """
select page_id, s as status, case s when 'SKIP' then 'No DOI or URL' when 'TIMEOUT' then 'Page load timeout' when 'CHALLENGE_UNRESOLVED' then 'captcha challenge not cleared' when 'LOGIN_REQUIRED' then 'Login wall still present after manual attempt'
 when 'ACCESS_DENIED' then 'Paywall — no institutional access' when 'NO_PDF_LINK' then 'No PDF link at ' || url when 'DOWNLOAD_FAILED' then 'No valid file produced' when 'INVALID_FILE' then 'Not a valid PDF' else 'Downloaded from ' || url || '.pdf' end as status_notes
from (select page_id, url, case when page_id % 13 <> 0 and (page_id % 11 = 0 or not starts_with(trim(url), 'http')) then 'SKIP' when page_id % 7 = 0 then 'TIMEOUT' when page_id % 6 = 0 then 'CHALLENGE_UNRESOLVED' when page_id % 10 = 0 and page_id % 5 <> 1 then 'LOGIN_REQUIRED'
 when page_id % 17 = 0 then 'ACCESS_DENIED' when page_id % 4 = 0 then 'NO_PDF_LINK' when page_id % 9 = 0 or page_id * 100 < 15000 then 'DOWNLOAD_FAILED' when page_id % 8 in (3, 5) then 'INVALID_FILE' else 'SUCCESS' end as s from pages) q"""


def search_log_q(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.operators import search

    docs = table(spark, d, "documents")
    queries = docs.select(F.col("lang").alias("query")).where("query is not null").distinct().select(F.concat(F.lit("g-"), "query").alias("group"), "query")
    found = docs.select(F.when(F.col("doc_id") % 3 == 0, "OpenAlex").otherwise("Crossref").alias("source_database"), F.col("lang").alias("search_query"))
    errors = spark.createDataFrame([("Crossref", "de", "timeout")], "source_database string, search_query string, error string")
    return search.search_log(queries, found, ("OpenAlex", "Crossref", "Semantic Scholar"), errors, now=F.timestamp_seconds(F.lit(0)))


QUERIES["search_log"] = search_log_q
ORACLES["search_log"] = """
with q as (select distinct lang from documents where lang is not null), s as (select unnest(['OpenAlex', 'Crossref', 'Semantic Scholar']) as source),
n as (select case when doc_id % 3 = 0 then 'OpenAlex' else 'Crossref' end as source, lang, count(*) as n from documents group by 1, 2)
select '1970-01-01T00:00:00Z' as timestamp_utc, s.source as source_database, q.lang as search_query, 'g-' || q.lang as search_group, 'keyword search' as search_mode,
 case when s.source = 'Crossref' and q.lang = 'de' then '0' else cast(coalesce(n.n, 0) as varchar) end as results_returned, case when s.source = 'Crossref' and q.lang = 'de' then 'ERROR' else 'OK' end as status, case when s.source = 'Crossref' and q.lang = 'de' then 'timeout' else '' end as notes
from q cross join s left join n on n.source = s.source and n.lang = q.lang"""


def refused_calls(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.operators import search

    calls = table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.when(F.col("n_nationkey").isin(14, 19), 429).when(F.col("n_nationkey") % 5 == 3, 500).otherwise(200).alias("http_status"))
    return search.stop_after_refusal(calls)


QUERIES["refused_calls"] = refused_calls
ORACLES["refused_calls"] = """
select n_nationkey as ord, cast(h as int) as http_status, case when n_nationkey > 14 then 'SKIPPED' when h = 200 then 'OK' else 'ERROR' end as outcome
from (select n_nationkey, case when n_nationkey in (14, 19) then 429 when n_nationkey % 5 = 3 then 500 else 200 end as h from nation) q"""


def confirmed_papers(spark: SparkSession, d: str) -> DataFrame:
    """What full-text screening confirms, in the columns that a configuration names."""
    from lodestone.operators import papers

    return papers.with_columns(papers.confirmed(fulltext.classify(*_papers(spark, d), FULL)), ["doc_id", "Title", "EE_value", "Product"])


QUERIES["confirmed_papers"] = confirmed_papers
ORACLES["confirmed_papers"] = f"""select cast(c.doc_id as varchar) as doc_id, t.title as "Title", c.ee_value as "EE_value", '' as "Product" from ({ORACLES["fulltext_classify"]}) c
 join (select conv_id as doc_id, substr(arg_min(text, turn), 1, 60) as title from conversations group by 1) t on t.doc_id = c.doc_id where c.classification = 'A. Confirmed'"""


def config_merge(spark: SparkSession, d: str) -> DataFrame:
    """A configuration of its own over a base, key by key, as key and value."""
    from lodestone.sources.config import merged

    regions = [r.r_name for r in table(spark, d, "region").orderBy("r_regionkey").collect()]  # five rows
    base = {"a": {"x": "1", "y": {"p": "2", "q": "3"}}, "l": ["1", "2"], **dict.fromkeys(regions, "base")}
    own = merged(base, {"a": {"y": {"q": "4"}, "z": "5"}, "l": ["9"], regions[0]: "own"})

    def flat(c: dict, path: str = "") -> list[tuple[str, str]]:
        return [x for k, v in c.items() for x in (flat(v, f"{path}{k}.") if isinstance(v, dict) else [(path + k, ",".join(v) if isinstance(v, list) else v)])]

    return spark.createDataFrame(flat(own), "key string, value string")


QUERIES["config_merge"] = config_merge
ORACLES["config_merge"] = """
with base as (select unnest(['a.x', 'a.y.p', 'a.y.q', 'l']) as key, unnest(['1', '2', '3', '1,2']) as value union all select r_name, 'base' from region),
own as (select unnest(['a.y.q', 'a.z', 'l']) as key, unnest(['4', '5', '9']) as value union all select r_name, 'own' from region where r_regionkey = 0)
select key, coalesce(o.value, b.value) as value from base b full join own o using (key)"""
