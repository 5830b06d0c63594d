"""Dated, linked cards of HTML pages, by generic selectors and by host rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.base import computed, q, sql_let
from pubwatch.functions.dates import sql_parse_datetime, sql_parse_index_date
from pubwatch.functions.text import briefing_identifier, clean_text, normalize_words, sql_clean_text, sql_fold
from pubwatch.functions.urls import (
    content_type, is_agency_homepage, same_site, url_host, url_hostname, url_join, url_path, url_scheme,
)
from pubwatch.operators.dedupe import first_link_per_page
from pubwatch.operators.filters import link_allowed
from pubwatch.sources import html as H

CARD, NODES = H.CARD, H.NODES
WRITTEN_DATE = r"(?i)(?:published|publication|updated|posted)(?:\s+date)?\s*[:\-]?\s*(\d{1,2}\s+[A-Za-z]+\s+\d{4})"
INLINE_DATE = r"Published:\s+(\d{1,2}\s+\w+\s+\d{4})"
BLOG_DATE = r"Blog publish date is\s+(\d{1,2}/\d{1,2}/\d{4})"
PUBLISHED_PREFIX, PINNED_PREFIX = r"^Published:\s*", r"^Pinned\s+article from\s+"


def _subtree(node: str) -> str:
    """SQL: the part of ``dom`` below a node, the node itself left out."""
    return (f"named_struct('nodes', filter({NODES}, n -> {H.below('n', node)}), "
            f"'texts', filter({H.TEXTS}, p -> p.pos > {node}.pre and p.pos <= {node}.post))")


def _cards(pages: DataFrame, found: str) -> DataFrame:
    """One row per selected element, with the element's own subtree as ``dom``.

    The subtree is cut out before the page is exploded, so no row carries the whole page.
    """
    cut = f"transform({found}, c -> named_struct('card', c, 'dom', {_subtree('c')}))"
    kept = [c for c in pages.columns if c not in ("body", "dom")]
    return pages.select(*kept, F.posexplode(F.expr(cut)).alias("position", "_c")).select(*kept, "position", "_c.card", "_c.dom")


def _cards_in_page(pages: DataFrame, found: str) -> DataFrame:
    """One row per selected element next to the whole page, for rules that look around the element."""
    return pages.drop("body").select("*", F.posexplode(F.expr(found)).alias("position", "card"))


def _with(df: DataFrame, **texts: str) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in texts.items()})


def _computed(df: DataFrame, **texts: str) -> DataFrame:
    return computed(df, {name: F.expr(text) for name, text in texts.items()})


def _or(first: str, second: str) -> str:
    return f"coalesce(nullif({first}, ''), {second})"


def _href(anchor: str) -> Column:
    return url_join(F.col("page_url"), F.expr(H.attr(anchor, "href")))


# --- index cards -------------------------------------------------------------------------------------


def _site_case(choices: dict[str, str], default: str) -> str:
    cases = " ".join(f"when {q(site)} then {text}" for site, text in choices.items())
    return f"case host {cases} else {default} end" if cases else default


def _generic_cards() -> str:
    extra = {site: H.select(s) for site, s in V.INDEX_EXTRA_CARDS.items()}
    for site, selector in V.INDEX_LINK_PARENT_CARDS.items():
        extra[site] = f"filter(transform({H.select(selector)}, a -> get({NODES}, a.parent)), a -> a is not null)"
    everything = f"concat({H.select(V.INDEX_CARDS)}, {_site_case(extra, f'slice({NODES}, 1, 0)')})"
    only_rules = ", ".join(q(site) for site in V.INDEX_RULE_ONLY_HOSTS)
    return f"if(host in ({only_rules}), slice({NODES}, 1, 0), {everything})"


def _rule_table(spark) -> DataFrame:
    """The host rules with their selectors compiled to path patterns; a table of fixed size."""
    def pattern(selector: str) -> str:
        return "|".join(H.path_pattern(s)[0] for s in selector.split(","))

    rows = [
        (site, V.INDEX_RULE_PATHS.get(site), pattern(card), None if anchor == ":self" else pattern(anchor), pattern(title),
         None if date == ":prefix" else pattern(date))
        for site, (card, anchor, title, date) in V.INDEX_RULES.items()
    ]
    return spark.createDataFrame(
        rows, "host string, rule_path string, card_rule string, anchor_rule string, title_rule string, date_rule string"
    )


def _by_rule(pattern: str) -> str:
    return f"filter({NODES}, n -> {H.below('n', CARD)} and n.path rlike {pattern})"


def index_cards(pages: DataFrame, since: Column, until: Column | None) -> DataFrame:
    """Cards of landed index pages: source_id, page_url, body -> records.

    A host in the rule table has its own cards next to the generic ones; adding a host means
    adding a rule.  Every page is tokenised once.
    """
    path = F.regexp_replace(url_path(F.col("page_url")), "/+$", "")
    dom = pages.withColumns({"host": url_host(F.col("page_url")), "path": path})
    dom = dom.where(F.expr(_site_case({site: f"path = {q(needed)}" for site, needed in V.INDEX_PATHS.items()}, "true")))
    dom = H.with_nodes(dom).join(F.broadcast(_rule_table(pages.sparkSession)), "host", "left")
    dom = _with(dom, generic=_generic_cards(), ruled=(
        f"if(card_rule is not null and coalesce(rule_path, path) = path, filter({NODES}, n -> n.path rlike card_rule), slice({NODES}, 1, 0))"
    ))
    tagged = (f"concat(transform(filter(generic, g -> not exists(ruled, r -> r.pre = g.pre)), g -> named_struct('by_rule', false, 'card', g, 'dom', {_subtree('g')})), "
              f"transform(ruled, r -> named_struct('by_rule', true, 'card', r, 'dom', {_subtree('r')})))")
    kept = ["page_url", "source_id", "host", "anchor_rule", "title_rule", "date_rule"]
    cards = dom.select(*kept, F.explode(F.expr(tagged)).alias("_t")).select(*kept, "_t.by_rule", "_t.card", "_t.dom").where(F.size("dom.nodes") + (F.col("card.tag") == "a").cast("int") > 0)

    # The parts of a generic card.
    cards = _with(
        cards,
        anchor="coalesce(" + ", ".join(H.first(s, CARD) for s in V.INDEX_ANCHORS) + ")",
        cover=H.first(V.INDEX_COVER_ANCHORS, CARD), cover_title=H.first(V.INDEX_COVER_TITLES, CARD),
        listed="if(host = 'slab.org.uk', " + H.first("a.page-listing-link[href]", CARD) + ", null)",
        slink="if(host = 'mwcscot.org.uk' and " + H.css(".sp-content", CARD) + ", " + H.first("a.slink[href]", CARD) + ", null)",
    )
    container, mental = H.css(".contentContainer", CARD), "(host = 'mwcscot.org.uk' and " + H.css(".sp-content", CARD) + ")"
    covered = "cover is not null and cover_title is not null"
    cards = _computed(
        cards,
        link_node=f"""case when by_rule then if(anchor_rule is null, card, get({_by_rule('anchor_rule')}, 0))
            when {covered} then cover when card.tag = 'a' then card when {container} then anchor
            when listed is not null then listed when {mental} then slink else anchor end""",
        title_node=f"""case when by_rule then get({_by_rule('title_rule')}, 0)
            when {covered} then cover_title when card.tag = 'a' then {H.first('h2, h3', CARD)} when {container} then {H.first('h2', CARD)}
            when listed is not null then {H.first('h2', CARD)} when {mental} then {H.first('h3', CARD)} else anchor end""",
    ).where("link_node is not null and title_node is not null").drop("anchor", "cover", "cover_title", "listed", "slink")

    # Date texts in the order they are tried.
    label = H.select("dl.ds_metadata dt", CARD)
    labelled = f"filter({label}, d -> {sql_fold(H.text_of('d'))} = 'date')"
    following = f"get(filter({NODES}, n -> n.parent = get(labels, 0).parent and n.tag = 'dd' and n.pre > get(labels, 0).pre), 0)"
    cards = _with(cards, time=H.first("time", CARD), semantic=H.first("span[property=dc:date][content]", CARD), labels=labelled)
    cards = _with(cards, described=following)
    stated = _or(f"if(described is not null, {H.text_of('described')}, '')", f"if(semantic is not null, {H.attr('semantic', 'content')}, '')")
    extra = _site_case({site: H.select(s, CARD) for site, s in V.INDEX_EXTRA_DATES.items()}, f"slice({NODES}, 1, 0)")
    shown = sql_let(H.text_of("n"), "raw", f"if({H.css('.updated', 'n')} and not startswith(raw, 'Published:'), null, regexp_replace(raw, {q(PUBLISHED_PREFIX)}, ''))")
    listed_dates = f"transform(reverse(concat({H.select(V.INDEX_DATES, CARD)}, {extra})), n -> {shown})"
    pinned = f"transform({_by_rule('date_rule')}, n -> regexp_replace({H.text_of('n')}, {q(PINNED_PREFIX)}, ''))"
    cards = _with(cards, stated=stated)
    cards = _with(cards, date_texts=f"""case
        when by_rule and date_rule is null then array(substring_index({H.text_of(CARD)}, ' - ', 1))
        when by_rule then {pinned}
        when time is not null then array({_or(H.attr('time', 'datetime'), H.text_of('time'))})
        when stated <> '' then array(stated) else {listed_dates} end""")
    parsed = f"get(filter(transform(date_texts, v -> {sql_parse_index_date('v')}), v -> v is not null), 0)"
    late = f"if(by_rule and not {H.css(V.INDEX_CARDS, CARD)}, 1, 0)"
    rows = _computed(
        cards, place=f"struct({late}, card.pre)", title=sql_clean_text(H.text_of("title_node")), href=H.attr("link_node", "href"), published_at=parsed, context=H.text_of(CARD),
    )
    return _dated_cards(rows.select(
        "page_url", "source_id", F.col("place").alias("position"), "title", url_join(F.col("page_url"), F.col("href")).alias("link"), "published_at", "context", F.lit("").alias("summary"),
    ), since, until)


def _dated_cards(cards: DataFrame, since: Column, until: Column | None) -> DataFrame:
    cards = computed(cards, {"title": F.col("title"), "link": F.col("link"), "published_at": F.col("published_at")})
    good = (
        (F.length("title") >= V.MINIMUM_TITLE_CHARS) & (F.col("published_at") >= since)
        & (url_hostname(F.col("link")) == url_hostname(F.col("page_url"))) & ~F.endswith(F.lower(url_path(F.col("link"))), F.lit(".pdf"))
        & (F.col("link") != F.col("page_url"))
    )
    if until is not None:
        good = good & (F.col("published_at") < until)
    return first_link_per_page(cards.where(good)).select(
        "source_id", "page_url", "title", "link", "published_at", "summary", F.col("page_url").alias("source_feed"),
        content_type(F.col("link"), F.col("title"), F.col("context")).alias("content_type"),
    )


def sibling_cards(pages: DataFrame, since: Column, until: Column | None) -> DataFrame:
    """Cards whose date is the element before the intro and whose summary is the one after it."""
    intro = _cards_in_page(H.with_nodes(pages), H.select(".news-short-article > .news-short-article-intro"))
    rows = _with(
        intro, before=f"if(card.prev >= 0, get({NODES}, card.prev), null)", after=f"if(card.next >= 0, get({NODES}, card.next), null)",
        anchor=H.first("a[href]", CARD),
    ).where(F.expr(f"anchor is not null and before is not null and {H.css('.news-short-article-date', 'before')}"))
    rows = _with(rows, summary=f"if(after is not null and {H.css('.news-short-article-text', 'after')}, {sql_clean_text(H.text_of('after'))}, '')")
    return _dated_cards(rows.select(
        "page_url", "source_id", "position", F.expr(sql_clean_text(H.text_of("anchor"))).alias("title"), _href("anchor").alias("link"),
        F.expr(sql_parse_index_date(H.text_of("before"))).alias("published_at"), F.col("summary").alias("context"), "summary",
    ), since, until)


def inline_date_cards(pages: DataFrame, since: Column, until: Column | None) -> DataFrame:
    """Linked headings of one court site whose date stands inside the anchor text."""
    links = _cards(H.with_nodes(pages), H.select("a[href^=/news/]"))
    written = q(r"\b\d{1,2} [A-Za-z]+ \d{4}\b")
    rows = _with(links, heading=H.first("[class*=line-clamp-2]", CARD), words=H.text_of(CARD))
    rows = _with(rows, date_text=f"regexp_extract(words, {written}, 0)").where("heading is not null and date_text <> ''")
    return _dated_cards(rows.select(
        "page_url", "source_id", "position", F.expr(sql_clean_text(H.text_of("heading"))).alias("title"), _href(CARD).alias("link"),
        F.expr(sql_parse_index_date("date_text")).alias("published_at"), F.col("words").alias("context"), F.lit("").alias("summary"),
    ).where(url_path(F.col("link")) != "/news/latest-judgments"), since, until)


# --- whole pages and official pages ------------------------------------------------------------------


def sql_node_date(within: str | None) -> str:
    """First date of: time elements, date metadata, structured data, "published: d Month yyyy" text."""
    metas = "meta[property=article:published_time], meta[property=datePublished], meta[name=date], meta[name=pubdate]"
    objects = sql_let(H.script_text("n"), "j", "if(startswith(trim(j), '['), from_json(j, 'array<map<string,string>>'), array(from_json(j, 'map<string,string>')))")
    keys = "array(o['datePublished'], o['dateCreated'], o['dateModified'])"
    texts = f"""concat(
        transform({H.select('time', within)}, n -> {_or(H.attr('n', 'datetime'), H.text_of('n'))}),
        transform({H.select(metas, within)}, n -> {H.attr('n', 'content')}),
        flatten(transform({H.select('script[type=application/ld+json]', within)}, n -> flatten(transform(coalesce({objects}, array()), o -> {keys})))),
        array(regexp_extract({sql_clean_text(H.page_text() if within is None else H.text_of(within))},
            {q(WRITTEN_DATE)}, 1)))"""
    return f"get(filter(transform({texts}, v -> {sql_parse_datetime('v')}), v -> v is not null), 0)"


def sql_node_summary(within: str | None) -> str:
    """Description metadata, else the first non-empty of four text selectors."""
    found = ", ".join(f"nullif({sql_let(H.first(s, within), 'e', sql_clean_text(H.text_of('e')))}, '')" for s in (".summary", ".description", ".govuk-body", "p"))
    described = H.first("meta[property=og:description], meta[name=description]", within)
    return sql_let(described, "m", f"if(m is not null, {sql_clean_text(H.attr('m', 'content'))}, coalesce({found}, ''))")


def page_items(pages: DataFrame, since: Column | None = None) -> DataFrame:
    """At most one record per page: a content page or a page with article metadata, dated and titled.

    ``pages``: source_id, page_url, body, homepage.
    """
    markers = "/collection/|/guidance/|/government/publications/|/government/consultations/|/report"
    content = F.lower(url_path(F.col("page_url"))).rlike(markers)
    metadata = F.expr(f"exists({NODES}, n -> {H.css('meta[property=article:published_time], meta[property=datePublished], script[type=application/ld+json]', 'n')})")
    dom = H.with_nodes(pages.where(~is_agency_homepage(F.col("page_url"), F.col("homepage")))).where(content | metadata)
    dom = _with(dom, heading=H.first("h1"), og=H.first("meta[property=og:title]"), name=H.first("title"))
    title = f"case when heading is not null then {H.text_of('heading')} when og is not null then {H.attr('og', 'content')} when name is not null then {H.text_of('name')} else '' end"
    rows = _computed(
        dom.select("source_id", "page_url", "dom", "heading", "og", "name"), title=sql_clean_text(title), published_at=sql_node_date(None), summary=sql_node_summary(None), context=H.page_text(),
    ).where((F.length("title") >= V.MINIMUM_TITLE_CHARS) & F.col("published_at").isNotNull())
    rows = rows.select("source_id", "page_url", "title", F.col("page_url").alias("link"), "published_at", "summary", F.col("page_url").alias("source_feed"), "context")
    rows = rows.withColumn("content_type", content_type(F.col("link"), F.col("title"), F.col("context"))).drop("context")
    return rows if since is None else rows.where(F.col("published_at") >= since)


def official_cards(pages: DataFrame, since: Column) -> DataFrame:
    """Cards of a source's supplemental page; ``pages``: source_id, page_url, body, homepage, patterns."""
    cards = _cards(H.with_nodes(pages), H.select("article, li, .search-result, .card"))
    found = _with(cards, anchor=H.first("h1 a[href], h2 a[href], h3 a[href], h4 a[href], a[href]", CARD)).where("anchor is not null")
    found = found.withColumn("link", _href("anchor")).where(
        (url_host(F.col("link")) != "") & (url_host(F.col("link")) == url_host(F.col("page_url")))
        & link_allowed(F.col("link"), F.col("patterns"), F.col("homepage"))
    )
    rows = _computed(
        found.select("source_id", "page_url", "position", "link", "anchor", "card", "dom"),
        title=sql_clean_text(H.text_of("anchor")), published_at=sql_node_date(CARD), summary=sql_node_summary(CARD), context=H.text_of(CARD), _link="regexp_replace(link, '/+$', '')",
    ).where((F.length("title") >= V.MINIMUM_TITLE_CHARS) & (F.col("published_at") >= since))
    return first_link_per_page(rows, link="_link").select(
        "source_id", "page_url", "title", "link", "published_at", "summary", F.col("page_url").alias("source_feed"),
        content_type(F.col("link"), F.col("title"), F.col("context")).alias("content_type"),
    )


def generic_links(pages: DataFrame, since: Column) -> DataFrame:
    """Every link with enough text, dated by the time element of its nearest article, li or div."""
    links = _cards_in_page(H.with_nodes(pages), H.select("a[href]"))
    around = f"filter({NODES}, n -> n.tag in ('article', 'li', 'div') and n.pre < card.pre and n.post >= card.post)"
    staged = _with(links, scope=f"coalesce(get(reverse({around}), 0), card)", href=H.attr(CARD, "href"))
    staged = _with(staged, time=H.first("time", "scope"))
    link = F.when(F.startswith("href", F.lit("/")), url_join(F.col("page_url"), F.col("href"))).otherwise(F.col("href"))
    stamp = f"if(time is not null, {_or(H.attr('time', 'datetime'), H.text_of('time'))}, '')"
    rows = _computed(staged.withColumn("link", link), title=sql_clean_text(H.text_of(CARD)), published_at=sql_parse_datetime(stamp)).where(
        (F.length("title") >= V.MINIMUM_TITLE_CHARS) & F.startswith("link", F.lit("http")) & (F.col("published_at") >= since)
    )
    return rows.select("source_id", "page_url", "title", "link", "published_at", F.col("page_url").alias("source_feed"))


# --- site adapters ------------------------------------------------------------------------------------


def adapter_cards(pages: DataFrame, since: Column) -> DataFrame:
    """Three site-specific card shapes, chosen by ``source_id`` in one pass over the pages."""
    shapes = {"Electoral Commission": "article.c-teaser", "NPSA": ".views-row", "Ofcom": "a[href]"}
    chosen = " ".join(f"when {q(source)} then {H.select(selector)}" for source, selector in shapes.items())
    cards = _cards(H.with_nodes(pages.where(F.col("source_id").isin(*shapes))), f"case source_id {chosen} end")
    cards = _with(
        cards, words=H.text_of(CARD), time=H.first("time", CARD), teaser=H.first(".c-teaser__title", CARD), lead=H.first(".c-teaser__desc", CARD),
        anchor=f"case source_id when 'Ofcom' then card when 'NPSA' then {H.first('h2 a[href], h3 a[href], .views-field-title a[href]', CARD)} else {H.first('a[href]', CARD)} end",
    ).where("anchor is not null")
    paragraphs = f"transform(filter({H.select('p', CARD)}, n -> not {H.css('.readmore', 'n')}), n -> {sql_clean_text(H.text_of('n'))})"
    cards = _with(
        cards,
        title=f"case source_id when 'Ofcom' then substring_index(words, 'Published:', 1) when 'NPSA' then {H.text_of('anchor')} else {H.text_of('teaser')} end",
        stamp=f"""case source_id when 'Ofcom' then regexp_extract(words, {q(INLINE_DATE)}, 1)
            when 'NPSA' then regexp_extract(words, {q(BLOG_DATE)}, 1)
            else if(teaser is not null and time is not null, {_or(H.attr('time', 'datetime'), H.text_of('time'))}, '') end""",
        summary=f"""case source_id when 'Ofcom' then '' when 'NPSA' then array_join(filter({paragraphs}, t -> t <> '' and t <> 'Latest Blog'), ' ')
            else if(lead is not null, {H.text_of('lead')}, '') end""",
    )
    rows = cards.select(
        "source_id", "page_url", clean_text(F.col("title")).alias("title"), _href("anchor").alias("link"), F.expr(sql_parse_datetime("stamp")).alias("published_at"),
        clean_text(F.col("summary")).alias("summary"), F.col("page_url").alias("source_feed"),
    )
    return rows.where((F.col("published_at") >= since) & ((F.col("source_id") != "Ofcom") | (F.length("title") >= V.MINIMUM_TITLE_CHARS)))


def briefing_cards(pages: DataFrame) -> DataFrame:
    """Topic-archive cards as briefings; ``pages``: archive_url, page_url, body, chamber, publisher."""
    cards = _cards_in_page(H.with_nodes(pages), H.select("article.card"))

    def labels(selector: str) -> str:
        return f"transform({H.select(selector, CARD)}, n -> {sql_clean_text(H.text_of('n'))})"

    after_date = f"get(filter({H.select('p', CARD)}, p -> p.prev >= 0 and {H.css('.card__date', f'get({NODES}, p.prev)')}), 0)"
    staged = _with(
        cards, anchor=H.first(".card__heading a[href]", CARD), time=H.first("time[datetime]", CARD), tags=labels(".tag-list a[href]"),
        types=labels(".tag-list a[href*=/type/]"), paragraph=after_date,
    ).where("anchor is not null and time is not null")
    rows = _with(
        staged, title=sql_clean_text(H.text_of("anchor")), published_at=sql_parse_datetime(H.attr("time", "datetime")),
        summary=f"if(paragraph is not null, {sql_clean_text(H.text_of('paragraph'))}, '')",
    ).withColumn("webpage_url", _href("anchor")).where("published_at is not null and title <> ''")
    built = F.concat(F.lit(V.BRIEFING_PDF_ROOT), "identifier", F.lit("/"), "identifier", F.lit(".pdf"))
    return rows.withColumn("identifier", briefing_identifier(F.col("webpage_url"), F.col("title"))).select(
        "page_url", "position", "published_at", "chamber", "publisher", "title", "summary", "identifier", "webpage_url",
        F.when(F.col("identifier").rlike("^(CBP|SN)-"), built).otherwise(F.lit("")).alias("pdf_url"),
        F.expr("filter(tags, t -> not array_contains(types, t))").alias("topics"),
        F.coalesce(F.get("types", 0), F.lit("Research Briefing")).alias("document_type"),
        F.concat(F.lit("Official topic archive: "), "archive_url").alias("fetched_from"),
    )


def in_range_dates(pages: DataFrame) -> DataFrame:
    """Does a page show a publication date in its local-day range?  Review and update labels do not count.

    ``pages``: page_url, body, start_day, end_day.
    """
    before = f"filter({NODES}, m -> m.parent = n.parent and m.pre < n.pre and m.tag in ('h3', 'h4', 'dt', 'span'))"
    label = sql_let(f"get(reverse({before}), 0)", "e", f"if(e is null, '', {sql_fold(sql_clean_text(H.text_of('e')))})")
    day = f"cast({sql_parse_datetime(_or(H.attr('n', 'datetime'), H.attr('n', 'content')))} as date)"
    shown = f"coalesce({label} not in ('reviewed', 'last reviewed', 'last updated', 'updated') and {sql_let(day, 'd', 'd >= start_day and d < end_day')}, false)"
    dated = H.select("time[datetime], meta[property=article:published_time], meta[name=datePublished]")
    return _with(H.with_nodes(pages), in_range=f"exists({dated}, n -> {shown})").select("page_url", "in_range")


# --- links --------------------------------------------------------------------------------------------


# A page is one fetched body.  One url may have been fetched more than once; then ``page`` names the columns that tell
# the bodies apart, and results carry them.

ONE_BODY_PER_URL = ("page_url",)


def page_links(pages: DataFrame) -> DataFrame:
    """One row per link: position, tag, path, href, absolute url, media type, rel and label."""
    links = _cards(H.with_nodes(pages), H.select("a[href], link[href]"))
    kept = [c for c in pages.columns if c != "body"]
    return _with(links, href=f"trim({H.attr(CARD, 'href')})").select(
        *kept, "position", F.col("card.tag").alias("tag"), F.col("card.path").alias("path"), "href", url_join(F.col("page_url"), F.col("href")).alias("url"),
        F.expr(f"lower({H.attr(CARD, 'type')})").alias("media"), F.expr(f"lower({H.attr(CARD, 'rel')})").alias("rel"), F.expr(H.text_of(CARD)).alias("label"),
    )


def discover_feeds(links: DataFrame, page: tuple[str, ...] = ONE_BODY_PER_URL) -> DataFrame:
    """Feeds a page declares, once each in page order: page_url, feed_urls."""
    declared = links.where(
        (F.col("tag") == "link") & (F.col("href") != "") & F.contains("rel", F.lit("alternate")) & F.col("media").rlike("rss|atom|xml")
    )
    return _per_page(declared, None, "feed_urls", page)


def advertised_feeds(links: DataFrame, page: tuple[str, ...] = ONE_BODY_PER_URL) -> DataFrame:
    """Declared feeds plus anchors that look like feeds, the first six of each page."""
    anchor = (F.col("tag") == "a") & (F.lower("label").rlike(r"\b(rss|atom)\b") | F.col("href").rlike(r"/(feed|rss)(/|[.?]|$)"))
    return _per_page(links.where(((F.col("tag") == "link") & F.col("media").rlike("rss|atom")) | anchor), 6, "feed_urls", page)


def _per_page(links: DataFrame, limit: int | None, name: str, page: tuple[str, ...]) -> DataFrame:
    """Distinct urls of one page in order.

    Repeats are combined before anything is listed, and a limited list is cut by rank first, so
    that no list is longer than its result.
    """
    once = links.groupBy(*page, "url").agg(F.min("position").alias("position"))
    if limit is not None:
        place = F.row_number().over(Window.partitionBy(*page).orderBy("position"))
        once = once.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "url"))), lambda s: s["url"])
    return once.groupBy(*page).agg(ordered.alias(name))


def text_feeds(pages: DataFrame) -> DataFrame:
    """The one body whose page states its feed as plain text; ``pages``: id, page_url, body."""
    stated = (
        (F.col("id") == V.TEXT_FEED_BODY) & (F.regexp_replace("page_url", "/+$", "") == V.TEXT_FEED_PAGE)
        & F.contains(clean_text(F.col("body")), F.lit(V.TEXT_FEED_URL))
    )
    return pages.select("id", "page_url", F.when(stated, F.array(F.lit(V.TEXT_FEED_URL))).otherwise(F.array().cast("array<string>")).alias("feed_urls"))


def news_links(links: DataFrame, limit: int = 3, page: tuple[str, ...] = ONE_BODY_PER_URL) -> DataFrame:
    """Candidate news-index links of a page, best first: page_url, url, rank, place."""
    index = F.lower(url_path(F.col("url"))).rlike(r"/(news|newsroom|press-releases)(/|$)")
    named = F.lower("label").rlike(r"\b(news|newsroom|press|media|publications|judgments|decisions|latest)\b")
    exact = normalize_words(F.col("label")).isin("news", "latest news", "newsroom", "press releases", "view all news")
    rank = F.when(exact, 0).when(index, 1).otherwise(2)
    good = links.where((F.col("tag") == "a") & same_site(F.col("url"), F.col("page_url")) & (named | index) & (F.length("label") < 60))
    once = good.groupBy(*page, "url").agg(F.min(F.struct(rank.alias("rank"), F.col("position").alias("position"))).alias("b"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy("b")))
    return placed.where(F.col("place") <= limit).select(*page, "url", F.col("b.rank").alias("rank"), "place")


def candidate_sites(links: DataFrame, limit: int = 3, page: tuple[str, ...] = ONE_BODY_PER_URL) -> DataFrame:
    """Links that identify a body's own site; ``links`` also carries name_en, shared and context.

    ``context`` says that a shared page's surrounding item or heading names the body.
    """
    label = normalize_words(F.col("label"))
    exact = label == normalize_words(F.col("name_en"))
    website = label.rlike(r"\b(website|visit|www)\b")
    site = url_host(F.col("page_url"))
    eligible = F.when(F.col("shared"), exact | (F.col("context") & website)).otherwise(
        exact | (website & (site.isin(*V.SHARED_PUBLISHERS) | (site == "mygov.scot")))
    )
    good = links.where(
        (F.col("tag") == "a") & ~F.expr(H.inside_any("path", "footer", "nav", "header")) & url_scheme(F.col("url")).isin("http", "https")
        & ~url_host(F.col("url")).isin(*V.SOCIAL_HOSTS) & eligible
        & (~same_site(F.col("url"), F.col("page_url")) | (F.col("shared") & exact & (F.col("url") != F.col("page_url"))))
    )
    once = good.groupBy(*page, "url").agg(F.min("position").alias("position"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy("position")))
    return placed.where(F.col("place") <= limit).select(*page, "url", "place")
