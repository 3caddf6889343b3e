"""Queries of the core, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.operators import catalog, nested, stored
from pagelattice.plans import audit, twins
from pagelattice.plans.rules import CATEGORIES, native, selected, site
from pagelattice.session import durable
from pagelattice.sources import frontier, probes
from pagelattice.sources.tables import table

FLAGSHIP = "stored_overall_scores"


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return nested.label_nodes(table(spark, folder, "audit_results"), "id", "details_json", "audit_results").unionAll(
        nested.label_nodes(table(spark, folder, "issues"), "id", "affected_pages_json", "issues")
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.elements(_nodes(spark, folder))


def p4_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark, folder)


def _p4_table(kind: str, *more: str):
    """One of the flat tables by type of node; every node keeps its owner row and its intervals."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return nested.node_tables(_nodes(spark, folder))[kind].select("source_table", "row_id", "node_path", *more)

    return query


def p4_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Values below each array element, counted through interval containment."""
    nodes = _nodes(spark, folder)
    return (
        nested.inside(nodes.where("is_element and kind <> 'null'"), nodes.where("kind = 'value'"))
        .groupBy("source_table", "row_id", F.col("outer_node_path").alias("node_path"))
        .agg(F.count(F.lit(1)).alias("values_below"))
    )


# --- rules


def rules_native(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's status by the rules that Catalyst evaluates."""
    got = audit.native_results(audit.prepare(table(spark, folder, "pages")), selected())
    return got.select("page_id", "rule_id", "status", "score")


def rules_dom(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's status by those rules of the page pass that SQL can decide from the html."""
    rules = [r for r in selected() if r.id in twins.RULES]
    parsed = audit.page_pass(audit.prepare(table(spark, folder, "pages")), rules, near=False)
    return audit.dom_results(parsed, rules).select("page_id", "rule_id", "status")


def _audit(spark: SparkSession, folder: str, *categories: str) -> audit.AuditFrames:
    """The audit of all pages with every table that the stored crawls can fill."""
    pages, links = table(spark, folder, "pages"), table(spark, folder, "links")
    return audit.Auditor(spark, categories=categories).audit(
        audit.prepare(pages), durable(probes.site_table(pages)), durable(probes.probe_table(pages, links)), durable(probes.redirect_table(pages))
    )


def rules_all(spark: SparkSession, folder: str) -> DataFrame:
    """All rules over all pages, counted by status."""
    return _audit(spark, folder).results.groupBy("audit_id", "category_id", "rule_id", "status").agg(F.count(F.lit(1)).alias("n"))


def probe_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """The best known status of every address."""
    return probes.probe_table(table(spark, folder, "pages"), table(spark, folder, "links")).select("url", "status_code")


def site_variants(spark: SparkSession, folder: str) -> DataFrame:
    """What the stored pages tell of each origin."""
    return probes.site_table(table(spark, folder, "pages")).select("origin", "robots_status", "sitemap_status", "www_status", "bare_status", "http_status")


def link_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Broken internal and external links, broken images and redirect chains of every page."""
    pages = table(spark, folder, "pages")
    parsed = durable(audit.page_pass(audit.prepare(pages), [], near=False))
    found = site.link_rules(parsed, probes.probe_table(pages, table(spark, folder, "links")), probes.redirect_table(pages))
    out = found[0]
    for part in found[1:]:
        out = out.unionAll(part)
    return out.select("page_id", "rule_id", "status")


def first_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Titles, descriptions and texts that an earlier page of the crawl has."""
    parsed = durable(audit.page_pass(audit.prepare(table(spark, folder, "pages")), [], near=False))
    out = site.first_seen(parsed)
    return out[0].unionAll(out[1]).unionAll(out[2]).select("page_id", "rule_id", "status")


def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Pages nearly the same as an earlier page of the crawl."""
    parsed = durable(audit.page_pass(audit.prepare(table(spark, folder, "pages")), []), "zstd")
    return site.near_duplicates(parsed).select("page_id", "rule_id", "status")


def crawl_frontier(spark: SparkSession, folder: str) -> DataFrame:
    """Pages reached breadth first over the stored links, from the start of every crawl; the budget is all addresses there are."""
    pages, links, crawls = (table(spark, folder, n) for n in ("pages", "links", "crawls"))
    hops = links.where("is_internal = 1").select("page_id", "href", F.col("id").alias("pos"))
    edges = hops.join(pages.select(F.col("id").alias("page_id"), "url"), "page_id").select("url", "href", "pos")
    start = [r[0] for r in crawls.where("start_url is not null").select("start_url").distinct().orderBy("start_url").collect()]  # a row per crawl
    return frontier.crawl(edges, start, max_pages=edges.select("href").distinct().count() + len(start)).select("url", "depth")


def audit_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of the audit of all pages, made from its results as those of a stored audit are."""
    pages = audit.prepare(table(spark, folder, "pages"))
    return audit.made_issues(_audit(spark, folder), pages)


def audit_categories(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).categories


def audit_overall(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).overall


def audit_page_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder).page_categories


def cross_page(spark: SparkSession, folder: str) -> DataFrame:
    """Duplicate titles, descriptions, texts and near copies."""
    parsed = durable(audit.page_pass(audit.prepare(table(spark, folder, "pages")), []), "zstd")
    out = site.near_duplicates(parsed)
    for part in site.first_seen(parsed):
        out = out.unionAll(part)
    return out


def extracted_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links as the extractor finds them in html."""
    parsed = audit.page_pass(audit.prepare(table(spark, folder, "pages")), [], near=False)
    return parsed.select("page_id", F.explode("facts.links").alias("l")).select("page_id", "l.href", "l.internal")


# --- stored data


def _stored(fn, *names: str):
    return lambda spark, folder: fn(*(table(spark, folder, n) for n in names))


def _latest_crawls(crawls: DataFrame) -> DataFrame:
    return stored.latest(crawls, "project_id").select("project_id", F.col("id").alias("crawl"), "crawl_id", "status")


def _overall(results: DataFrame) -> DataFrame:
    return stored.overall_scores(stored.category_scores(results))


def _compare(audits: DataFrame, results: DataFrame) -> DataFrame:
    return stored.compare_audits(stored.audit_pairs(audits), results)


def _deltas(audits: DataFrame, results: DataFrame) -> DataFrame:
    return stored.category_deltas(stored.audit_pairs(audits), stored.category_scores(results))


def _issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("audit_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warning"),
    )


def _link_cache(pages: DataFrame, links: DataFrame) -> DataFrame:
    """The cache that the stored crawls fill, at the end of their last day."""
    cache = durable(catalog.cached(probes.probe_table(pages, links.where("false")), probes.probe_table(pages, links)))
    now = cache.agg(F.max("checked_at")).first()[0]
    return catalog.cache_stats(cache, F.lit(now).cast("timestamp"))


def _audit_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("audit_id").agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail")),
        F.count_distinct("page_url").alias("pages"),
    )


QUERIES = {
    **{
        q.__name__: q
        for q in (
            *(p4_found, p4_nodes, p4_descendants, rules_native, rules_dom, rules_all, audit_categories, audit_overall),
            *(audit_page_scores, audit_issues, crawl_frontier, cross_page, extracted_links, probe_statuses, site_variants, link_checks, first_copies, near_copies),
        )
    },
    "p4_objects": _p4_table("objects"),
    "p4_arrays": _p4_table("arrays"),
    "p4_values": _p4_table("values", "value"),
    "stored_latest_crawls": _stored(_latest_crawls, "crawls"),
    "stored_page_counts": _stored(stored.page_counts, "pages"),
    "stored_one_per_url": _stored(lambda p: stored.one_per_url(p).select("id", "crawl_id", "url_hash"), "pages"),
    "stored_url_hash": _stored(lambda p: p.select("id", stored.url_hash(F.col("url")).alias("hash")), "pages"),
    "stored_error_pages": _stored(lambda p: p.where("status_code >= 400 or error_message is not null").select("id", "url", "status_code", "error_message"), "pages"),
    "stored_broken_links": _stored(stored.broken_links, "links", "pages"),
    "stored_external_links": _stored(stored.external_links, "links"),
    "stored_link_counts": _stored(stored.link_counts, "links", "pages"),
    "stored_unlinked_pages": _stored(stored.unlinked_pages, "pages", "links"),
    "stored_category_scores": _stored(stored.category_scores, "audit_results"),
    "stored_overall_scores": _stored(_overall, "audit_results"),
    "stored_audit_counts": _stored(_audit_counts, "audit_results"),
    "stored_failed_rules": _stored(stored.failed_rules, "audit_results"),
    "stored_issues": _stored(stored.make_issues, "audit_results"),
    "stored_top_issues": _stored(lambda r: stored.top_issues(stored.make_issues(r)), "audit_results"),
    "stored_issue_counts": _stored(_issue_counts, "issues"),
    "stored_compare": _stored(_compare, "audits", "audit_results"),
    "stored_category_deltas": _stored(_deltas, "audits", "audit_results"),
    "stored_score_trend": _stored(stored.score_trend, "audits"),
    "stored_grouped_messages": _stored(stored.grouped_messages, "audit_results"),
    "stored_failed_results": _stored(
        lambda r: catalog.results_of(r, limit=None, status=["fail", "warn"]).select("id", "audit_id", "rule_id", "status", "score"), "audit_results"
    ),
    "stored_audit_list": _stored(
        lambda a: catalog.listed(a, catalog.newest(), status="completed").select("id", "audit_id", "domain", "overall_score"), "audits"
    ),
    "stored_audit_domains": _stored(
        lambda a: catalog.audit_domains(a).withColumn("last_started_at", F.unix_micros("last_started_at")), "audits"
    ),
    "stored_crawl_list": _stored(catalog.crawl_list, "crawls", "projects"),
    "stored_weighed_categories": _stored(lambda r: catalog.weighed_categories(stored.category_scores(r)), "audit_results"),
    "stored_html_storage": _stored(catalog.html_storage, "pages"),
    "stored_internal_links": _stored(lambda l: catalog.links_of(l, internal=True).select("id", "page_id", "href"), "links"),
    "stored_table_counts": lambda spark, folder: catalog.table_counts(
        **{n: table(spark, folder, n) for n in ("projects", "crawls", "pages", "links", "audits", "audit_results", "issues")}
    ),
    "stored_link_statuses": _stored(
        lambda l, p: catalog.link_statuses(l, probes.probe_table(p, l)).select("id", "target_status_code"), "links", "pages"
    ),
    "stored_link_cache": _stored(_link_cache, "pages", "links"),
    "stored_images": _stored(catalog.images, "pages"),
    "stored_image_stats": _stored(lambda p: catalog.image_stats(catalog.images(p)), "pages"),
    "stored_image_formats": _stored(lambda p: catalog.image_formats(catalog.images(p)), "pages"),
    "text_measures": _stored(stored.text_measures, "documents"),
    "text_exact_copies": _stored(stored.exact_copies, "documents"),
}


def _native_sql() -> str:
    """The Catalyst rules in DuckDB's dialect, one branch per rule."""
    vitals = ", ".join(f"case when cwv_{c} >= 0 then cwv_{c} end as {c}" for c in ("lcp", "cls", "inp", "fcp", "ttfb"))
    path, query = (native.render(x, native.DUCKDB) for x in (native.PATH, native.QUERY))
    base = (
        f"with p as (select id as page_id, url, html, status_code as status, headers_json, "
        f"case when load_time_ms >= 0 then load_time_ms end as ms, {vitals}, {path} as path, {query} as query "
        "from pages where html is not null)"
    )
    rules = [r for r in selected() if r.kind == "native"]
    columns = ", ".join(f"{native.render(r.run, native.DUCKDB)} as \"{r.id}\"" for r in rules)
    return (
        f"{base}, wide as (select page_id, {columns} from p), long as (unpivot wide on columns(* exclude page_id) into name rule_id value status)"
        " select page_id, rule_id, status, cast(case status when 'P' then 100 when 'W' then 50 else 0 end as int) as score from long"
    )


_CATEGORY = """cat as (select audit_id, category_id,
  cast(round(sum((case status when 'pass' then 100 when 'warn' then 50 else 0 end) * (case when score > 0 then score else 1 end))
    / sum(case when score > 0 then score else 1 end)) as int) as score,
  count(*) filter (status = 'pass') as passed, count(*) filter (status = 'warn') as warned, count(*) filter (status = 'fail') as failed
  from audit_results group by audit_id, category_id)"""
_WEIGHTS = "w(category_id, weight) as (values " + ", ".join(f"('{k}', {n})" for k, (_, n) in CATEGORIES.items()) + ")"
_BROKEN = "(coalesce(target_status_code >= 400, false) or target_error is not null)"
_RANKED = """ranked as (select id, domain, overall_score,
  row_number() over (partition by domain order by started_at desc nulls last, id desc) as k from audits)"""
_PAIRS = """pairs as (select a.domain, a.id as audit_id, b.id as previous_id, a.overall_score, b.overall_score as previous_score
  from ranked a left join ranked b on a.domain = b.domain and b.k = 2 where a.k = 1)"""
_ISSUES = """made as (select audit_id, rule_id, category_id, case status when 'fail' then 'critical' else 'warning' end as severity,
  rule_name as title, message as description, count(distinct page_url) as affected_pages,
  cast(round((case status when 'fail' then 100 else 50 end) * log10(count(distinct page_url) + 1)) as int) as priority_score
  from audit_results where status in ('fail', 'warn') group by audit_id, rule_id, category_id, rule_name, message, status)"""

# Fields as documents: a string that holds JSON is read once more, what cannot be read gives nothing.
_DOCS = """raw as (select 'audit_results' as source_table, id as row_id, details_json as j from audit_results
    union all select 'issues', id, affected_pages_json from issues),
  valid as (select source_table, row_id, j from raw where json_valid(j)),
  docs as (select source_table, row_id, j from valid where json_type(j) <> 'VARCHAR'
    union all select source_table, row_id, j ->> '$' from valid where json_type(j) = 'VARCHAR' and json_valid(j ->> '$')),
  nodes as (select source_table, row_id, t.id, t.parent, t.type, t.key, t.atom, replace(regexp_replace(t.fullkey, '^[$][.]?', ''), '"', '') as node_path,
    replace(regexp_replace(t.path, '^[$][.]?', ''), '"', '') as holder from docs, json_tree(docs.j) t)"""
_KINDS = "case type when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then 'null' else 'value' end"

ORACLE_SQL: dict[str, str] = {
    "p4_found": f"""with {_DOCS} select n.source_table, n.row_id, n.node_path, regexp_extract(n.holder, '^.*[]]') as parent_path
        from nodes n join nodes a on a.source_table = n.source_table and a.row_id = n.row_id and a.id = n.parent
        where a.type = 'ARRAY' and n.type <> 'NULL'""",
    "p4_descendants": f"""with recursive {_DOCS}, up as (
          select source_table, row_id, id as leaf, parent from nodes where type not in ('OBJECT', 'ARRAY', 'NULL')
          union all select u.source_table, u.row_id, u.leaf, n.parent from up u join nodes n on n.source_table = u.source_table and n.row_id = u.row_id and n.id = u.parent)
        select e.source_table, e.row_id, e.node_path, count(*) as values_below from up u
        join nodes e on e.source_table = u.source_table and e.row_id = u.row_id and e.id = u.parent
        join nodes a on a.source_table = e.source_table and a.row_id = e.row_id and a.id = e.parent and a.type = 'ARRAY'
        group by all""",
    "p4_objects": f"with {_DOCS} select source_table, row_id, node_path from nodes where type = 'OBJECT'",
    "p4_arrays": f"with {_DOCS} select source_table, row_id, node_path from nodes where type = 'ARRAY'",
    "p4_values": f"""with {_DOCS} select source_table, row_id, node_path, case when type = 'VARCHAR' then atom ->> '$' else cast(atom as varchar) end as value
        from nodes where type not in ('OBJECT', 'ARRAY', 'NULL')""",
    "rules_native": _native_sql(),
    "rules_dom": twins.dom_sql(),
    "extracted_links": twins.links_sql(),
    "probe_statuses": f"with {twins.PROBES} select url, status_code from probes",
    "link_checks": twins.link_checks_sql(),
    "first_copies": twins.first_copies_sql(),
    "near_copies": twins.near_copies_sql(),
    "stored_latest_crawls": """select project_id, id as crawl, crawl_id, status from (select *, row_number() over
        (partition by project_id order by started_at desc nulls last, id desc) as k from crawls) where k = 1""",
    "stored_page_counts": """select crawl_id, count(*) as n_pages,
        count(*) filter (status_code >= 200 and status_code < 300) as n_2xx, count(*) filter (status_code >= 300 and status_code < 400) as n_3xx,
        count(*) filter (status_code >= 400 and status_code < 500) as n_4xx, count(*) filter (status_code >= 500) as n_5xx,
        count(error_message) as n_errors, cast(coalesce(sum(html_size), 0) as bigint) as html_size from pages group by crawl_id""",
    "stored_one_per_url": """select id, crawl_id, url_hash from (select *, row_number() over
        (partition by crawl_id, url_hash order by crawled_at desc nulls last, id desc) as k from pages) where k = 1""",
    "stored_url_hash": "select id, substr(sha256(url), 1, 16) as hash from pages",
    "stored_error_pages": "select id, url, status_code, error_message from pages where status_code >= 400 or error_message is not null",
    "stored_broken_links": f"""select l.page_id, l.id as link_id, href, target_status_code, target_error, crawl_id, url
        from links l join pages p on p.id = l.page_id where {_BROKEN}""",
    "stored_external_links": "select distinct href from links where is_internal = 0",
    "stored_link_counts": f"""select crawl_id, count(*) as total, count(*) filter (is_internal = 1) as internal,
        count(*) filter (is_internal = 0) as external, count(*) filter (is_nofollow = 1) as nofollow, count(*) filter {_BROKEN} as broken
        from links l join pages p on p.id = l.page_id group by crawl_id""",
    "stored_unlinked_pages": """select id, crawl_id, url from pages p where not exists (select 1 from links l join pages q on q.id = l.page_id
        where l.is_internal = 1 and q.crawl_id = p.crawl_id and l.href = p.url)""",
    "stored_category_scores": f"with {_CATEGORY} select * from cat",
    "stored_overall_scores": f"""with {_CATEGORY}, {_WEIGHTS} select audit_id, cast(round(sum(score * weight) / sum(weight)) as int) as overall_score
        from cat join w using (category_id) group by audit_id""",
    "stored_audit_counts": """select audit_id, count(*) as total, count(*) filter (status = 'pass') as pass, count(*) filter (status = 'warn') as warn,
        count(*) filter (status = 'fail') as fail, count(distinct page_url) as pages from audit_results group by audit_id""",
    "stored_failed_rules": "select audit_id, rule_id, count(*) as fails from audit_results where status = 'fail' group by audit_id, rule_id",
    "stored_issues": f"with {_ISSUES} select * from made",
    "stored_top_issues": f"""with {_ISSUES}, r as (select *, cast(row_number() over (partition by audit_id order by priority_score desc,
        affected_pages desc, rule_id, severity, description) as int) as rank from made) select * from r where rank <= 5""",
    "stored_issue_counts": """select audit_id, count(*) as total, count(*) filter (severity = 'critical') as critical,
        count(*) filter (severity = 'warning') as warning from issues group by audit_id""",
    "stored_compare": f"""with {_RANKED}, {_PAIRS}, changed as (
          select p.domain, count(distinct n.rule_id) as new_issues from pairs p join audit_results n on n.audit_id = p.audit_id and n.status = 'fail'
          left join audit_results o on o.audit_id = p.previous_id and o.rule_id = n.rule_id
          where p.previous_id is not null and (o.id is null or o.status <> 'fail') group by p.domain),
        fixed as (
          select p.domain, count(distinct n.rule_id) as fixed_issues from pairs p join audit_results n on n.audit_id = p.previous_id and n.status = 'fail'
          left join audit_results o on o.audit_id = p.audit_id and o.rule_id = n.rule_id
          where o.id is null or o.status <> 'fail' group by p.domain)
        select domain, audit_id, previous_id, overall_score - previous_score as score_delta, coalesce(new_issues, 0) as new_issues,
          coalesce(fixed_issues, 0) as fixed_issues from pairs left join changed using (domain) left join fixed using (domain)""",
    "stored_category_deltas": f"""with {_RANKED}, {_PAIRS}, {_CATEGORY} select p.domain, c.category_id, c.score, coalesce(o.score, 0) as previous_score,
        c.score - coalesce(o.score, 0) as delta from pairs p join cat c on c.audit_id = p.audit_id
        left join cat o on o.audit_id = p.previous_id and o.category_id = c.category_id""",
    "stored_score_trend": f"""with {_RANKED} select domain, id as audit_id, overall_score,
        overall_score - lag(overall_score) over (partition by domain order by k desc) as delta from ranked where k <= 10""",
    "stored_failed_results": "select id, audit_id, rule_id, status, score from audit_results where status in ('fail', 'warn')",
    "stored_audit_list": "select id, audit_id, domain, overall_score from audits where status = 'completed'",
    "stored_audit_domains": """select domain, count(*) as audits, count(*) filter (status = 'completed') as completed, max(overall_score) as best_score,
        epoch_us(max(started_at)) as last_started_at from audits group by domain""",
    "stored_crawl_list": """select c.id, crawl_id, project_id, domain, status, cast(row_number() over (partition by project_id order by started_at desc nulls last, c.id desc) as int) as place
        from crawls c left join projects p on p.id = c.project_id""",
    "stored_weighed_categories": f"""with {_CATEGORY}, {_WEIGHTS} select audit_id, category_id, score, coalesce(weight, 0) as weight,
        cast(row_number() over (partition by audit_id order by coalesce(weight, 0) desc, category_id) as int) as place from cat left join w using (category_id)""",
    "stored_html_storage": """select crawl_id, count(*) as pages, cast(coalesce(sum(html_size), 0) as bigint) as html_bytes, cast(sum(length(html)) as bigint) as stored_chars,
        count(*) filter (html_compressed = 1) as compressed from pages where html is not null group by crawl_id""",
    "stored_internal_links": "select id, page_id, href from links where is_internal = 1",
    "stored_table_counts": " union all ".join(
        f"select '{n}' as name, count(*) as rows from {n}" for n in ("projects", "crawls", "pages", "links", "audits", "audit_results", "issues")
    ),
    "stored_link_statuses": f"""with {twins.PROBES} select l.id, case when target_status_code is null and target_error is null then q.status_code else target_status_code end as target_status_code
        from links l left join probes q on q.url = l.href""",
    "stored_link_cache": f"""with {twins.PROBES.replace("select url, status_code from (select", "select url, status_code, seen_at from (select")}
        select count(*) as entries, count(*) filter (seen_at >= m - interval 7 day) as fresh, count(*) filter (seen_at < m - interval 7 day) as stale,
        count(*) filter (status_code >= 400 or status_code = 0) as failed from probes, (select max(seen_at) as m from probes)""",
    "stored_grouped_messages": r"""select audit_id, category_id, rule_id, status, 
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message,
          '\d+ chars?', 'X chars', 'g'), '\d+ words?', 'X words', 'g'), '\d+ images?', 'X images', 'g'), '\d+ links?', 'X links', 'g'),
          '\d+px', 'Xpx', 'g'), '\d+ms', 'Xms', 'g'), '\d+KB', 'XKB', 'g'), '\d+\.\d+s', 'X.Xs', 'g') as masked,
        count(distinct page_url) as n_pages from audit_results where status <> 'pass' group by all""",
    "text_measures": r"""with d as (select doc_id, coalesce(text, '') as t from documents), c as (select *, len(regexp_extract_all(t, '[A-Z]')) as capitals,
        len(regexp_extract_all(t, '[ .,:;!|]')) as thin from d)
        select doc_id, cast(len(list_filter(regexp_split_to_array(regexp_replace(lower(t), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda x: x <> '')) as bigint) as n_words,
        cast(greatest(1, len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: regexp_replace(x, '\s', '', 'g') <> ''))) as bigint) as n_sentences,
        cast(round(9.5 * capitals + 4.0 * thin + 7.5 * (length(t) - capitals - thin)) as bigint) as pixel_width from c""",
    "text_exact_copies": """select doc_id, first_id, copies from documents join (select md5(text) as key, min(doc_id) as first_id, count(*) as copies
        from documents where text is not null group by 1 having count(*) > 1) g on g.key = md5(text)""",
}
