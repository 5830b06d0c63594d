"""Word lists, tables, patterns and limits that results depend on.

Everything in this module is a plain constant.  Nothing here is computed from data
and no other module repeats these literals.
"""

# --- fixed values: matching weights and levels ---------------------------------------
STRENGTHS = ("core", "general", "supporting")
STRENGTH_LABELS = {"core": "核心", "general": "一般", "supporting": "輔助"}
TITLE_WEIGHTS = {"core": 6, "general": 4, "supporting": 2}
SUMMARY_WEIGHTS = {"core": 4, "general": 3, "supporting": 1}
LEVEL_HIGH, LEVEL_MEDIUM, LEVEL_LOW = "高", "中", "低"
LEVEL_HIGH_FROM, LEVEL_MEDIUM_FROM = 8, 5
DEFAULT_MINIMUM_SCORE = 3
SHORT_PHRASE_CHARS = 3
CORE_PHRASE_CHARS = 10

# --- fixed values: boilerplate removed before matching ------------------------------
BOILERPLATE_PHRASES = (
    "Department for Business, Innovation, Science and Trade",
    "Department for Science, Innovation and Technology",
    "Department for Digital, Culture, Media and Sport",
    "Department for Science, Innovation & Technology",
    "Department for Culture, Media and Sport",
    "Government Digital Service",
    "AI Security Institute",
    "AI Safety Institute",
)
BOILERPLATE_SENTENCES = (
    " is the uk's communications regulator",
    " is the uk's independent authority",
    " is responsible for ",
    "we are responsible for",
    "find out more about ",
    "follow us on ",
    "subscribe to ",
    "contact the press office",
    "published by ",
)

# --- fixed values: built-in topic profile --------------------------------------------
PROFILE_VERSION = 1
PROFILE_ID_PATTERN = "^[a-z0-9][a-z0-9-]{1,48}$"
DEFAULT_PROFILE_ID = "uk-tech-law"
DEFAULT_PROFILE_NAME = "UK 科技法制"
DEFAULT_PROFILE_DESCRIPTION = "英國科技、AI、資料治理、平台、資安、半導體與量子政策觀測"
DEFAULT_SOURCES = (
    "BIST", "DCMS", "AISI", "ICO", "CMA", "UK IPO", "GDS", "Ofcom", "NCSC",
    "Electoral Commission", "Cabinet Office", "NPSA", "UKRI", "UK Parliament",
)
BRIEFINGS_SOURCE_ID = "UK Parliament"
SUPPORTING_PHRASES = (
    "copyright", "evaluation", "innovation", "platform", "resilience", "supply chain",
    "technology", "cookies", "national security", "procurement", "interoperability",
    "government procurement",
)
TOPIC_PHRASES = {
    "Science & Technology": (
        "science", "scientific", "science and technology", "sci tech", "technology",
        "technological", "innovation", "research and development", "R&D",
    ),
    "AI": (
        "artificial intelligence", "AI", "machine learning", "foundation model",
        "foundation models", "frontier model", "frontier AI", "generative AI",
        "automated decision", "automated decision-making", "algorithm",
        "algorithmic accountability", "explainability", "fairness", "AI Safety Institute",
        "AI Security Institute", "model evaluation", "evaluation", "copyright",
        "text and data mining", "TDM", "privacy-by-design", "AI and data protection",
        "AI risk management", "AI assurance", "AI adoption", "AI infrastructure",
        "AI hardware", "AI Research Resource", "compute roadmap",
    ),
    "資料治理/隱私/數位身份": (
        "data protection", "UK GDPR", "GDPR", "Data Protection Act",
        "international data transfer", "adequacy", "standard contractual clauses",
        "data use", "data access", "digital sovereignty", "open data", "data reuse",
        "data reuse policy", "Open Government Data Framework", "Digital ID",
        "digital identity", "trust framework", "GOV.UK One Login", "One Login",
        "UK Digital Identity and Attributes Trust Framework",
        "storage and access technologies", "tracking technologies", "cookies",
    ),
    "數位平台": (
        "online safety", "Online Safety Act", "platform", "illegal content",
        "child safety", "social media", "social media ban", "deepfake", "deepfakes",
        "illegal intimate images", "recommendation algorithm", "algorithm transparency",
        "media plurality", "media green paper", "broadcast impartiality",
        "online influence transparency", "disinformation", "misinformation",
        "foreign information manipulation", "electoral information manipulation",
        "digital markets", "mobile platform", "mobile platforms",
        "Digital Markets Competition and Consumers Act", "Strategic Market Status", "SMS",
        "systemic risk", "app store", "app stores", "mobile ecosystem", "search services",
        "cyberflashing", "fraudulent advertising",
    ),
    "網路安全/資安": (
        "cyber", "cybersecurity", "network and information systems", "NIS",
        "critical infrastructure", "critical national infrastructure", "product security",
        "telecommunications infrastructure", "vulnerability",
        "coordinated vulnerability disclosure", "secure by design", "secure-by-design",
        "SBOM", "software bill of materials", "supply chain",
        "government cyber security strategy", "Cyber Essentials", "incident response",
        "resilience", "protective security", "hybrid threat", "hybrid threat resilience",
        "critical infrastructure protection", "national cyber resilience",
        "secure innovation", "connected device security",
        "software security code of practice", "cyber resilience pledge",
    ),
    "數位治理/標準/公共部門": (
        "digital standards strategy", "digital standards", "technology standards",
        "AI standards", "standards hub", "government procurement", "public sector AI",
        "digital trade governance", "communications market report", "national security",
        "procurement", "interoperability",
    ),
    "半導體/量子技術": (
        "semiconductor", "National Semiconductor Strategy", "semiconductor strategy",
        "chip", "microelectronics", "export control", "quantum",
        "National Quantum Strategy", "quantum technologies", "quantum computing",
        "quantum R&D",
    ),
}
RETIRED_SOURCE_IDS = {
    "DSIT": ("BIST", "DCMS", "Cabinet Office"),
    "DBT": ("BIST",),
}

# --- fixed values: built-in source dimension -----------------------------------------
GOV_LINK_PATTERNS = (
    "/government/news/",
    "/guidance/",
    "/government/publications/",
    "/government/consultations/",
    "/government/research/",
    "/government/statistics/",
)
GOV_ORGANISATIONS = "https://www.gov.uk/government/organisations/"
# short name, Chinese name, English name, homepage, feeds, news pages, official pages, patterns
AGENCIES = (
    ("BIST", "商業、創新、科學及貿易部", "Department for Business, Innovation, Science and Trade",
     GOV_ORGANISATIONS + "department-for-business-innovation-science-and-trade",
     (GOV_ORGANISATIONS + "department-for-business-innovation-science-and-trade.atom",), (),
     (GOV_ORGANISATIONS + "department-for-business-innovation-science-and-trade",), GOV_LINK_PATTERNS),
    ("DCMS", "數位、文化、媒體及體育部", "Department for Digital, Culture, Media and Sport",
     GOV_ORGANISATIONS + "department-for-culture-media-and-sport",
     (GOV_ORGANISATIONS + "department-for-culture-media-and-sport.atom",), (),
     (GOV_ORGANISATIONS + "department-for-culture-media-and-sport",), GOV_LINK_PATTERNS),
    ("AISI", "人工智慧安全研究所", "AI Security Institute",
     GOV_ORGANISATIONS + "ai-safety-institute",
     (GOV_ORGANISATIONS + "ai-safety-institute.atom",), (),
     (GOV_ORGANISATIONS + "ai-safety-institute",), GOV_LINK_PATTERNS),
    ("ICO", "英國資訊專員辦公室", "Information Commissioner's Office",
     "https://ico.org.uk/about-the-ico/media-centre/news-and-blogs/", (),
     ("https://ico.org.uk/about-the-ico/media-centre/news-and-blogs/",),
     ("https://ico.org.uk/for-organisations/uk-gdpr-guidance-and-resources/",), ()),
    ("CMA", "競爭與市場管理局", "Competition and Markets Authority",
     GOV_ORGANISATIONS + "competition-and-markets-authority",
     (GOV_ORGANISATIONS + "competition-and-markets-authority.atom",), (),
     (GOV_ORGANISATIONS + "competition-and-markets-authority",), GOV_LINK_PATTERNS),
    ("UK IPO", "英國智財局", "UK Intellectual Property Office",
     GOV_ORGANISATIONS + "intellectual-property-office",
     (GOV_ORGANISATIONS + "intellectual-property-office.atom",), (),
     (GOV_ORGANISATIONS + "intellectual-property-office",), GOV_LINK_PATTERNS),
    ("GDS", "政府數位服務團隊", "Government Digital Service",
     GOV_ORGANISATIONS + "government-digital-service",
     (GOV_ORGANISATIONS + "government-digital-service.atom",), (),
     (GOV_ORGANISATIONS + "government-digital-service",), GOV_LINK_PATTERNS),
    ("Ofcom", "英國通訊管理局", "Office of Communications", "https://www.ofcom.org.uk/",
     ("https://www.ofcom.org.uk/news-centre/rss",), ("https://www.ofcom.org.uk/news-and-updates",),
     ("https://www.ofcom.org.uk/news-and-updates",), ()),
    ("NCSC", "國家網路安全中心", "National Cyber Security Centre", "https://www.ncsc.gov.uk/",
     ("https://www.ncsc.gov.uk/api/1/services/v1/all-rss-feed.xml",), (),
     ("https://www.ncsc.gov.uk/collection/what-to-do-when-cyber-attacks-disrupt-your-organisation",
      "https://www.ncsc.gov.uk/collection/what-to-do-when-cyber-attacks-disrupt-your-organisation/recovering",
      "https://www.ncsc.gov.uk/collection/what-to-do-when-cyber-attacks-disrupt-your-organisation/recovering/immediate-activities",
      "https://www.ncsc.gov.uk/collection/what-to-do-when-cyber-attacks-disrupt-your-organisation/recovering/recovering-ongoing-investigations",
      "https://www.ncsc.gov.uk/collection/what-to-do-when-cyber-attacks-disrupt-your-organisation/recovering/rebuild"),
     ()),
    ("Electoral Commission", "英國選舉委員會", "Electoral Commission",
     "https://www.electoralcommission.org.uk/", (),
     ("https://www.electoralcommission.org.uk/news-and-views/media-centre",),
     ("https://www.electoralcommission.org.uk/news-and-views/media-centre",), ()),
    ("Cabinet Office", "英國內閣辦公室", "Cabinet Office", GOV_ORGANISATIONS + "cabinet-office",
     (GOV_ORGANISATIONS + "cabinet-office.atom",), (),
     (GOV_ORGANISATIONS + "cabinet-office",), GOV_LINK_PATTERNS),
    ("NPSA", "國家保護安全局", "National Protective Security Authority", "https://www.npsa.gov.uk/", (),
     ("https://www.npsa.gov.uk/blog",), ("https://www.npsa.gov.uk/blog",), ()),
    ("UKRI", "英國研究與創新總署", "UK Research and Innovation", "https://www.ukri.org/",
     ("https://www.ukri.org/feed/",), (),
     ("https://www.ukri.org/news/",
      "https://www.ukri.org/who-we-are/how-we-are-doing/evaluation-reports/browse/",
      "https://www.ukri.org/what-we-do/what-we-have-funded/investment-and-outputs-publication/"), ()),
)

# --- fixed values: health thresholds and budgets --------------------------------------
MINIMUM_ITEMS = {"BIST": 1, "DCMS": 1, "Ofcom": 1, "Cabinet Office": 1}
MAXIMUM_AGE_DAYS = {
    "BIST": 14, "DCMS": 14, "Ofcom": 14, "Cabinet Office": 14, "CMA": 30, "NCSC": 30,
    "UK IPO": 45, "ICO": 45, "Electoral Commission": 45, "AISI": 60, "GDS": 60,
    "NPSA": 60, "UKRI": 60,
}
BRIEFING_FEED_MINIMUM_ITEMS = 1
BRIEFING_FEED_MAXIMUM_AGE_DAYS = 14
STALENESS_PERIOD_DAYS = 30
BUDGET_SUCCESS_RATE = 0.90
BUDGET_P95_SECONDS = 60.0
BUDGET_ZERO_RATIO = 0.25
BUDGET_PEAK_MEMORY_MB = 30.0
BENCH_BUDGET_MS = {"1000": 10.0, "10000": 30.0}
BENCH_REGRESSION_FACTOR = 1.30
BASELINE_MINIMUM_RUNS = 3

# --- fixed values: calendar -------------------------------------------------------------
LOCAL_ZONE = "Asia/Taipei"
DEFAULT_PERIOD_DAYS = 14
ROC_YEAR_OFFSET = 1911
ROC_FIRST_DAY = "1912-01-01"
FEED_PAGE_ENTRIES = 10
MINIMUM_TITLE_CHARS = 12
HISTORY_LIMIT = 30

# --- fixed values: briefings ------------------------------------------------------------
CHAMBERS = {
    "House of Commons Library": "House of Commons",
    "House of Lords Library": "House of Lords",
    "Parliamentary Office of Science and Technology": "POST",
}
BRIEFING_ID_PATTERN = r"\b(?:CBP|SN|LLN|POST-PN|POSTNOTE|POSTBRIEF)-?\d+\b"
BRIEFING_SLUG_PATTERN = r"/(?:research-briefings/)?((?:cbp|sn|lln|post-pn)-\d+)/?"
BRIEFING_PDF_PATTERN = r"""https?://[^\s"'<>]+\.pdf(?:\?[^\s"'<>]*)?"""
BRIEFING_PDF_ROOT = "https://researchbriefings.files.parliament.uk/documents/"
BRIEFING_LABEL_KEYS = ("_value", "prefLabel", "label", "title", "name")

# --- fixed values: fallback search feed ------------------------------------------------
AGGREGATOR_HOST = "news.google.com"
# source, publisher host, must contain, title suffix pattern
FALLBACK_RULES = (
    ("Ofcom", "ofcom.org.uk", "www.ofcom.org.uk", r"\s+-\s+(Ofcom\s+-\s+)?www\.ofcom\.org\.uk$"),
    ("NPSA", "npsa.gov.uk", "", r"(?i)\s+-\s+National Protective Security Authority(?:\s+\|\s+NPSA)?$"),
    ("Electoral Commission", "electoralcommission.org.uk", "", r"(?i)\s+-\s+Electoral Commission$"),
    ("ICO", "ico.org.uk", "", r"(?i)\s+-\s+ICO$"),
)
FALLBACK_EXCLUDED_TITLES = {
    "Electoral Commission": (
        "search criteria", "home page | electoral commission", "donation summary",
        "loan summary", "qualifications", "living abroad", "resources for media",
    ),
}
FALLBACK_EXCLUDED_PREFIXES = {
    "Electoral Commission": ("search criteria", "donation summary", "loan summary"),
}

# --- fixed values: index-card rules by host: card, anchor, title, date -------------------
INDEX_RULES = {
    "cvsni.org": ("article", "a.no-underline[href]", "h2", "p.italic"),
    "publichealth.hscni.net": (".node--type-news", "h3 a[href]", "h3 a[href]", ".node--type-news > p strong"),
    "stmarys-belfast.ac.uk": ("a.news-item", ":self", "h4", ".text-pale-sky"),
    "ukri.org": (".category-research-england", "a[href]", ".entry-title", ".post-summary__date"),
    "audit.scot": (".ac-latest-news > div", "h3 a[href]", "h3 a[href]", "time"),
    "portonbiopharma.com": ("a.post-item-inner", ":self", "h3", ".post-date"),
    "prosecutioninspectorate.scot": (".news-landing", "h2 a[href]", "h2 a[href]", ".article-date"),
    "hmfsi.scot": (".publication-list-item", "h2 a[href]", "h2 a[href]", ".meta-date"),
    "hmics.scot": (".article-landing-list-item", "h2 a[href]", "h2 a[href]", ".meta-date"),
    "oscr.org.uk": (".news-item", "a[href]", "h3", ".date"),
    "fuelpovertypanel.scot": ("li.ds_category-item", "h3 a[href]", "h3 a[href]", ".publishedDate"),
    "qmscotland.co.uk": (".featured-article", "a[href]", "h2", ".date"),
    "ombudsman.wales": (".newslist-item", "a.newslist-item-link", "a.newslist-item-link", ".newslist-item-date"),
    "uksbs.co.uk": (".card", ".content a[href]", ".content h3", "p.article-date"),
    "consumer.scot": ("article", "a.news-item__link", ".news-item__title", ".news-item__link-date"),
    "crownestatescotland.com": (".views-view-responsive-grid__item", "a[href]", "a[href]", ".views-field-localgov-news-date"),
    "nhshighland.scot.nhs.uk": (".featured-article, .article", "a[href]", ".article__title", ".article__detail"),
    "pirc.scot": (".publication-item", "a.publication-item--heading", "h3", ".publication-item--date"),
    "scottishcanals.co.uk": (".entry-card", "h2 a[href]", "h2 a[href]", "dd.entry-card-meta-value"),
    "housingregulator.gov.scot": ("a.signpost--news", ":self", "h2", ".signpost__date"),
    "southofscotlandenterprise.com": (".items .item", "a[href]", "h3", "a > p"),
    "foi.scot": (".intro_desc > p", "a[href]", "a[href]", ":prefix"),
}
INDEX_PATHS = {
    "cvsni.org": "/news",
    "publichealth.hscni.net": "/news",
    "stmarys-belfast.ac.uk": "/about-us/news",
    "ukri.org": "/councils/research-england/news",
}
INDEX_RULE_PATHS = {"audit.scot": "/accounts-commission"}
INDEX_RULE_ONLY_HOSTS = ("ukri.org",)
INDEX_CARDS = (
    "article, li, .search-result, .card, .views-row, .news-listing, .newsResult__item, "
    ".news-list__item, a.list__item, a.homepage-panel-link, .news-result, .card-body, "
    ".featuredItemContent, .contentContainer"
)
INDEX_EXTRA_CARDS = {"mwcscot.org.uk": ".sp-content", "foodstandards.gov.scot": "a.grid-card[href]"}
INDEX_LINK_PARENT_CARDS = {"slab.org.uk": "a.page-listing-link[href]"}
INDEX_ANCHORS = ("h2 a[href]", "h3 a[href]", "h4 a[href]", ".views-field-title a[href]", "a[href]")
INDEX_COVER_ANCHORS = "a.stretched-link[href], a.card-link[href], a.newsResult__cta[href], a.link--cover[href], a.cover[href]"
INDEX_COVER_TITLES = ".card-title, .newsResult__itemTitle, .news-list__title, .card-main h3.title"
INDEX_DATES = (
    ".ds_news-item__meta p, .PubDate p, .card-text small, .newsResult__date, .post-meta .published, "
    ".news-list__date, .listing-item p, .updated, .homepage-panel-footer small, .news-result p.date, "
    ".card-body p.article-date, .featuredItemContent span.date, .card-meta p.date, "
    ".contentContainer p.date, p.pub-date"
)
INDEX_EXTRA_DATES = {
    "slab.org.uk": "p.date-display",
    "mwcscot.org.uk": "p.meek",
    "foodstandards.gov.scot": ".grid-card-info date",
}

# --- fixed values: catalogue review ------------------------------------------------------
SHARED_PUBLISHERS = (
    "gov.uk", "gov.wales", "gov.scot", "nidirect.gov.uk", "nationalarchives.gov.uk",
    "judiciary.uk", "scotcourts.gov.uk", "judiciaryni.uk", "publicappointmentsni.org",
)
SOCIAL_HOSTS = ("facebook.com", "twitter.com", "x.com", "youtube.com", "linkedin.com", "instagram.com")
# host -> (source id, publisher name)
RELATED_PUBLISHERS = {
    "ukri.org": ("UKRI", "UK Research and Innovation"),
    "audit.scot": ("scotland:audit-scotland", "Audit Scotland"),
    "dhcw.nhs.wales": ("wales:digital-health-and-care-wales", "Digital Health and Care Wales"),
    "awttc.nhs.wales": ("", "All Wales Therapeutics and Toxicology Centre"),
    "scotcourts.gov.uk": ("court-scotland:judgments", "Scottish Courts and Tribunals Service judgments"),
    "futuregenerations.wales": (
        "wales:future-generations-commissioner-wales", "Future Generations Commissioner for Wales"),
}
SCOPED_PARENT_INDEXES = {
    "govuk:research-england": "https://www.ukri.org/councils/research-england/news/",
    "scotland:accounts-commission-for-scotland": "https://audit.scot/accounts-commission",
}
TEXT_FEED_BODY = "scotland:scottish-courts-and-tribunals-service"
TEXT_FEED_PAGE = "https://www.scotcourts.gov.uk/rss-feeds"
TEXT_FEED_URL = "https://api.pa.web.scotcourts.gov.uk/web/rss/NewsArticles"
CLOSED_SOURCES = ("govuk:bbc", "court-ew:find-case-law")
KEPT_SCOPED_SOURCES = (
    "govuk:research-england", "scotland:accounts-commission-for-scotland",
    "scotland:scottish-courts-and-tribunals-service",
)
OBSOLETE_SOURCE = "govuk:military-engineering-experimental-establishment"
OBSOLETE_EVIDENCE = "https://mexe.org.uk/"
ASSESSMENT_OUTCOMES = (
    "covered_by_parent", "no_verified_endpoint", "html_adapter_required",
    "network_or_access_error", "permission_required", "policy_excluded",
    "parser_verification_failed", "audit_error", "available_as_other_source",
    "feed_validation_failed",
)
EXCLUSION_OUTCOMES = (
    "covered_by_parent", "available_as_other_source", "policy_excluded", "obsolete_source",
    "user_requested_removal",
)
BUILT_IN_SLUGS = (
    "department-for-business-innovation-science-and-trade",
    "department-for-culture-media-and-sport", "ai-safety-institute",
    "competition-and-markets-authority", "intellectual-property-office",
    "government-digital-service", "cabinet-office", "information-commissioner-s-office",
    "ofcom", "national-cyber-security-centre", "the-electoral-commission",
    "national-protective-security-authority", "uk-research-and-innovation",
)
DIRECTORY_ONLY_SLUGS = ("bbc",)
DIRECTORY_MINIMUM_ROWS = {"wales": 150, "ni": 80, "courts": 35}
UNVERIFIED_REASON = "尚未驗證獨立官方發布頁"
TRANSIENT_STATUSES = (0, 429, 500, 502, 503, 504)
ALIAS_MARKERS = {
    "Northern Ireland": ("northern ireland",),
    "Scotland": ("scotland", "scottish"),
    "Wales": ("wales", "welsh"),
}

# --- fixed values: directories of public bodies and their literal rows -------------------
SCOTLAND_DIRECTORY = "https://www.gov.scot/publications/national-public-bodies-directory/"
WALES_DIRECTORY = "https://www.gov.wales/organisations"
NI_DEPARTMENTS = "https://www.nidirect.gov.uk/contacts/government-departments-in-northern-ireland"
NI_BODIES = "https://www.publicappointmentsni.org/list-bodies-we-regulate"
NI_FINANCE_DIRECTORY = "https://www.finance-ni.gov.uk/articles/list-bodies-which-public-procurement-policy-statement-applies"
EW_COURTS = "https://www.judiciary.uk/structure-of-courts-and-tribunals-system/"
SCOTLAND_COURTS = "https://www.scotcourts.gov.uk/courts-and-tribunals/"
WALES_TRIBUNALS = "https://www.gov.wales/welsh-tribunals/about-us"
NI_COURTS = "https://www.judiciaryni.uk/"
NI_COURTS_EVIDENCE = "https://www.judiciaryni.uk/files/judiciaryni/media-files/Court%20Structure%20in%20Northern%20Ireland_1.pdf"
NI_FINANCE_BODIES = (
    "Public Prosecution Service for Northern Ireland", "Attorney General for Northern Ireland",
    "Commissioner for Public Appointments for Northern Ireland",
    "Commissioner for Survivors of Institutional Childhood Abuse", "Community Relations Council",
    "Driver and Vehicle Agency", "Education Training Inspectorate",
    "Equality Commission for Northern Ireland", "Exceptional Circumstances Body", "Fiscal Council",
    "Forensic Science Northern Ireland", "Forest Service", "Legal Services Agency Northern Ireland",
    "Northern Ireland Courts and Tribunals Service", "Northern Ireland Environment Agency",
    "Northern Ireland Prison Service", "Northern Ireland Prisoner Ombudsman",
    "Northern Ireland Statistics and Research Agency",
    "Planning Appeals and Water Appeals Commission", "Police Service of Northern Ireland",
    "Victims and Survivors Service Ltd", "Victims’ Payment Board", "Youth Justice Agency",
)
SCOTLAND_COURT_PAGES = {
    "Court of Session": SCOTLAND_COURTS + "the-supreme-courts/the-court-of-session/",
    "High Court of Justiciary": SCOTLAND_COURTS + "the-supreme-courts/the-high-court-of-justiciary/",
    "Sheriff Appeal Court": SCOTLAND_COURTS + "appeals-courts/",
    "Sheriff Courts": SCOTLAND_COURTS + "sheriff-and-justice-of-the-peace-courts/",
    "Justice of the Peace Courts": SCOTLAND_COURTS + "sheriff-and-justice-of-the-peace-courts/",
    "Scottish Tribunals": SCOTLAND_COURTS + "scottish-tribunals/",
    "Upper Tribunal for Scotland": SCOTLAND_COURTS + "scottish-tribunals/",
    "First-tier Tribunal for Scotland": SCOTLAND_COURTS + "scottish-tribunals/",
}
WALES_TRIBUNAL_NAMES = (
    "Adjudication Panel for Wales", "Agricultural Land Tribunal for Wales",
    "Mental Health Review Tribunal for Wales", "Education Tribunal for Wales",
    "Residential Property Tribunal Wales", "Welsh Language Tribunal",
)
NI_COURT_NAMES = (
    "Court of Appeal in Northern Ireland", "High Court of Justice in Northern Ireland",
    "Crown Court in Northern Ireland", "County Court in Northern Ireland",
    "Magistrates' Courts in Northern Ireland", "Northern Ireland Tribunal Service",
)
# id -> (name, jurisdiction, homepage, feed, provenance)
COURT_FEEDS = {
    "court-ew:judgments": (
        "Courts and Tribunals Judiciary judgments", "England and Wales", "https://www.judiciary.uk/judgments/",
        "https://www.judiciary.uk/judgments/feed/", "https://www.judiciary.uk/rss-feeds/"),
    "court-ew:announcements": (
        "Courts and Tribunals Judiciary announcements", "England and Wales", "https://www.judiciary.uk/announcements/",
        "https://www.judiciary.uk/announcements/feed/", "https://www.judiciary.uk/rss-feeds/"),
    "court-scotland:judgments": (
        "Scottish Courts and Tribunals Service judgments", "Scotland", "https://www.scotcourts.gov.uk/judgments/",
        "https://api.pa.web.scotcourts.gov.uk/web/rss/Judgments", "https://www.scotcourts.gov.uk/rss-feeds/"),
}

# --- fixed values: challenge page ------------------------------------------------------
CHALLENGE_WINDOW_CHARS = 10000

# --- fixed values: rule-based title translation ----------------------------------------
TITLE_TRANSLATIONS = {
    "Building more resilient CNI: what industry pen testers told us":
        "打造更具韌性的關鍵國家基礎設施：產業滲透測試人員的回饋",
    "Cyber Shield: The path to an agentic AI future for cyber defence":
        "Cyber Shield：邁向具代理式 AI 的網路防禦未來",
}
ELECTION_NAMES = {"scottish parliament": "蘇格蘭議會", "senedd": "參議院"}
MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
)

# --- fixed values: report column titles --------------------------------------------------
NEWS_COLUMNS = ("編號", "部會", "新聞日期", "單位分類", "資料類型", "新聞標題", "新聞連結")
MATCH_COLUMNS = ("命中觀測領域", "命中關鍵字", "相關性", "分數", "核心關聯詞", "一般關聯詞", "輔助關聯詞")
BRIEFING_COLUMNS = (
    "資料日期", "國家", "機關", "院別", "資料來源類型", "發布單位", "主題分類", "文件類型",
    "標題", "摘要", "識別碼", "網頁連結", "PDF連結", "抓取來源",
)
LIST_SEPARATOR = "、"
WARNING_SEPARATOR = "；"
