"""Vocabularies and patterns whose wording decides results.

Everything here is data. The lists are stated plainly so that a reader can check them against a
portal; callers may pass their own vocabulary wherever a function takes one.
"""

# --- Fixed values: places -------------------------------------------------------------------

# City filter -> terms that satisfy it (the city and its country-level names).
LOCATION_EXPANSIONS = {
    "madrid": ["madrid", "spain", "españa", "espana"],
    "barcelona": ["barcelona", "spain", "españa", "espana"],
    "bilbao": ["bilbao", "spain", "españa", "espana"],
    "valencia": ["valencia", "spain", "españa", "espana"],
    "sevilla": ["sevilla", "seville", "spain", "españa", "espana"],
    "london": ["london", "uk", "u.k.", "united kingdom", "england", "great britain"],
}

# Peer cities by region: naming one that was not asked for rejects the text.
PEER_CITIES = {
    "es": [
        "madrid", "barcelona", "bilbao", "valencia", "sevilla", "seville",
        "zaragoza", "malaga", "málaga", "murcia", "palma", "las palmas",
        "alicante", "vigo", "gijón", "gijon", "córdoba", "cordoba", "valladolid",
        "vitoria", "granada", "elche", "oviedo", "santander", "pamplona", "donostia",
        "san sebastián", "san sebastian", "albacete", "burgos", "salamanca",
        "huelva", "lleida", "tarragona", "leon", "león", "cádiz", "cadiz",
        "logroño", "logrono", "badajoz", "almería", "almeria", "girona", "toledo",
    ],
    "uk": [
        "london", "glasgow", "edinburgh", "manchester", "birmingham", "liverpool",
        "bristol", "leeds", "sheffield", "newcastle", "cardiff", "belfast",
        "nottingham", "leicester", "coventry", "southampton", "brighton",
        "aberdeen", "dundee", "oxford", "cambridge", "york", "bath", "reading",
        "milton keynes", "swansea", "portsmouth", "plymouth", "hull",
    ],
}

# --- Fixed values: portal-specific place codes ----------------------------------------------

# Country option of the geographical drop-down, per city filter.
CARD_LINK_COUNTRY_CODES = {"madrid": "74", "barcelona": "74", "spain": "74"}

# Province option, per city filter; anything else falls back to Madrid's.
PROVINCE_CODES = {
    "madrid": "28",
    "barcelona": "8",
    "valencia": "46",
    "alicante": "3",
    "malaga": "29",
    "zaragoza": "50",
    "las palmas": "35",
}
PROVINCE_FALLBACK = "28"

# Display label of the location drop-down, per city filter.
CARD_LOCATION_LABELS = {
    "madrid": "Spain - Madrid",
    "barcelona": "Spain - Madrid",
    "london": "UK - London",
    "new york": "USA - New York",
    "athens": "Greece - Athens",
    "stockholm": "Sweden - Stockholm",
    "milan": "Italy - Milan",
    "frankfurt": "Germany - Frankfurt",
}

# Office ids sent as the search filter of the board that serves HTML inside JSON.
BOARD_OFFICE_IDS = "139513,180711"

# --- Fixed values: titles -------------------------------------------------------------------

GENERIC_TITLES = [
    "empleo", "employment", "job", "jobs", "career", "careers", "ver oferta",
    "view job", "apply", "apply now", "learn more", "see more", "details",
    "ver más", "más información", "full-time", "part-time", "internship",
    "prácticas", "becas", "remote", "hybrid", "on-site", "spain", "spain (español)",
    "españa", "english", "spanish", "español",
    "saved jobs", "saved job", "ofertas guardadas", "oferta guardada",
    "job alerts", "alertas de empleo", "search jobs", "buscar empleo",
    "events", "students", "professionals", "experienced hires", "experienced opportunities",
    "student opportunities", "graduate opportunities", "diversity programs",
    "leadership letters", "giving back", "find your place", "our work areas",
    "integrated teams", "students and graduates", "graduate program", "our locations",
    "our offices", "open positions", "all opportunities", "browse jobs", "all jobs",
    "search vacancies", "campus opportunities", "rss feed", "more jobs", "view all",
    "all positions", "show more", "load more", "my account", "sign in", "sign up",
    "create account", "see the offer", "see offer", "see job", "view offer",
    "view position", "ver oferta completa", "más detalles", "more details", "read more",
    "view details", "consultar oferta", "ir a la oferta", "ver puesto",
    "add to favorites", "add to favourites", "save", "save job", "save this job",
    "share", "share this job", "favorite", "favourite", "bookmark",
    "add to wishlist", "guardar", "guardar oferta", "compartir",
    "it & digital", "data", "global banking & investor solutions",
    "financial department", "general inspection, audit & consulting", "human resources",
    "compliance, legal & risk", "operations", "marketing & communications",
]

NON_JOB_WORDS = [
    "virtual", "remote", "hybrid", "office", "onsite", "fulltime", "parttime",
    "internship", "diversity", "graduate", "experienced", "entry", "senior",
    "junior", "manager", "intern", "campus", "events", "all", "home", "more",
    "search", "jobs", "careers", "apply", "register", "login", "spain",
]

ROLE_STEMS = [
    "analyst", "associate", "intern", "internship", "graduate", "off-cycle", "summer",
    "vice president", "vp", "director", "managing director", "principal",
]
SECTION_PHRASES = [
    "opportunities in", "students & graduates", "experienced hires", "current openings",
    "open positions",
]

# --- Fixed values: URLs ---------------------------------------------------------------------

STRONG_PATH_PARTS = [
    "/job/", "/jobs/", "/empleo/", "/oferta/", "/ofertas/", "/vacante/",
    "/vacancy/", "/vacancies/", "/posting/", "/postings/", "/jobad/",
    "/requisition/", "/requisitions/", "/puesto/", "/trabajo/",
]
STRONG_PATH_STEMS = [
    "empleo", "oferta", "vacante", "vacancy", "puesto", "trabajo", "posting", "requisition",
    "jobad", "job", "jobs",
]
WEAK_PATH_PARTS = [
    "/career", "/careers/", "/opening", "/programme", "/internship",
    "/graduate", "/role", "/becas", "/practicas", "/position", "/offer",
    "/apply", "/opportunit", "/jobsearch", "/job-search", "/job-",
]
JOB_QUERY_KEYS = ["jobid", "job_id", "vacancyid", "reqid", "requisitionid", "positionid"]
CANONICAL_ID_KEYS = [
    "id", "jobid", "job_id", "requisitionid", "reqid", "positionid", "vacancyid",
]
NAVIGATION_PATH_PARTS = [
    "/saved-jobs", "/saved_jobs", "/savedjobs", "/my-jobs", "/myjobs",
    "/job-alerts", "/jobalerts", "/alertas-de-empleo", "/ofertas-guardadas",
    "/login", "/sign-in", "/signin", "/register", "/sign-up", "/signup",
    "/account", "/profile", "/cuenta", "/mi-perfil", "/saved-searches",
    "/job-search", "/jobs-search", "/job-recruitment-scams",
    "/recruitment-scams", "/hiring-process", "/hiring-fraud",
    "/job-simulations", "/job-simulation",
    "/find-a-job", "/find-a-role", "/find-jobs", "/find-roles",
    "/buscar-trabajo", "/buscar-empleo", "/busqueda-de-empleo",
    "/experienced-professionals/", "/experienced-hires/",
]
SKIPPED_RESPONSE_PATHS = [
    "/event", "/facet", "/locale", "/translation", "/saved", "/recommend", "/notification",
    "/globalsetting", "/setting",
]
JOB_RESPONSE_WORDS = [
    "job", "vacanc", "posting", "requisition", "opening", "career", "search",
    "opportunit", "position", "recruit", "oferta", "empleo", "cxs", "cx_",
]
TRACKING_PARAMS = [
    "source", "ref", "referrer", "channel", "campaign",
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
]
HTML_JOB_CLASS_WORDS = ["job", "position", "role", "opening", "vacancy", "career", "offer"]
HTML_JOB_HREF_PARTS = ["/job", "/jobs/", "/position", "/career", "/opening", "/vacancy", "/offer"]

# --- Fixed values: JSON member names, in order of preference ---------------------------------

JSON_ROLE_KEYS = {
    "title": [
        "title", "jobtitle", "postingtitle", "job_title", "displayjobtitle", "name",
        "displayname", "postingtemplatetitle",
    ],
    "url": [
        "url", "absolute_url", "applyurl", "joburl", "hostedurl", "permalink", "link", "href",
        "external_path", "externalpath", "externalurl",
    ],
    "id": [
        "id", "jobid", "requisitionid", "reqid", "externalid", "external_id", "jobpostingid",
        "postingid", "jobreqid",
    ],
    "location": [
        "location", "locations", "locationtext", "locationstext", "city",
        "primarylocation", "primary_location", "officecity", "office", "country", "region",
        "geo", "workcity", "workcountry",
    ],
    "department": [
        "department", "departments", "businessunit", "business_unit", "category", "function",
        "jobcategory", "job_category", "jobfunction", "team", "division",
    ],
}
JSON_LABEL_KEYS = ["name", "label", "city", "displayname", "text", "title"]

# --- Fixed values: portal routing ------------------------------------------------------------

# (kind, host or suffix, path fragment, parser): the first rule that fits decides.
HOST_RULES = [
    ("suffix", "myworkdayjobs.com", None, "workday"),
    ("host", "www.alantra.com", None, "wp_cards"),
    ("host", "alantra.com", None, "wp_cards"),
    ("host", "careers.bcg.com", None, "phenom"),
    ("host", "bdo.epreselec.com", None, "id_permalink"),
    ("host", "www.acciona.com", None, "embedded_json"),
    ("host", "acciona.com", None, "embedded_json"),
    ("host", "caixabankcareers.com", None, "successfactors"),
    ("host", "www.caixabankcareers.com", None, "successfactors"),
    ("host", "empleo.es.deloitte.com", None, "successfactors"),
    ("host", "jobs.ca-cib.com", None, "card_links"),
    ("host", "jobs.amundi.com", None, "card_links"),
    ("host", "www.dcadvisory.com", None, "headings"),
    ("host", "dcadvisory.com", None, "headings"),
    ("host", "eyglobal.yello.co", None, "html_in_json"),
    ("host", "www.mckinsey.com", None, "status_cards"),
    ("host", "mckinsey.com", None, "status_cards"),
    ("host", "www.mediobanca.com", None, "intervieweb"),
    ("host", "mediobanca.com", None, "intervieweb"),
    ("host", "www.morganstanley.com", None, "resultset"),
    ("host", "morganstanley.com", None, "resultset"),
    ("host", "careers.marsh.com", "oliver-wyman", "phenom"),
    ("host", "www.pwc.es", None, "html_table"),
    ("host", "pwc.es", None, "html_table"),
    ("suffix", ".tal.net", None, "atom"),
    ("host", "jobs.ubs.com", None, "query_routed"),
]
# Configured platform -> parser, when no host rule fits.
PLATFORM_PARSERS = {
    "greenhouse": "greenhouse",
    "lever": "lever",
    "html": "html_listing",
    "playwright": "discover",
    "workday": "workday",
}

# Pages of the portal whose openings stand on one page per program.
PROGRAM_PAGES = [
    "https://www.pwc.es/es/carrera-profesional/student-job-search/results.html?wdcountry=ESP&wdjobsite=Global_Campus_Careers&wdprog=b78cd3deaf49102755292a6430e60000&wdgrade=1840265",
    "https://www.pwc.es/es/carrera-profesional/student-job-search/results.html?wdcountry=ESP&wdjobsite=Global_Campus_Careers&wdprog=181d27aa0ec21027504f21f399fe0000&wdgrade=1840265",
    "https://www.pwc.es/es/carrera-profesional/becas-y-practicas-profesionales/results.html?wdcountry=ESP&wdjobsite=Global_Campus_Careers&wdprog=3205d7f4e6a110274f8dbea37a590000&wdgrade=12669415",
    "https://www.pwc.es/es/carrera-profesional/student-job-search/results.html?wdcountry=ESP&wdjobsite=Global_Campus_Careers&wdprog=3205d7f4e6a110274f8dbea37a590000&wdgrade=1840265",
]
# Text of a page that a portal's bot protection serves.
BLOCK_PAGE_TEXT = "you have been blocked"
