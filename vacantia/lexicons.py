"""Term tables used by the rules.

Every table is a plain Python literal so that it can be read, diffed and written to
Parquet or CSV with :func:`vacantia.functions.lexicon_tables.lexicon_frame`.
"""

from __future__ import annotations

CS, IEM, EE = "computer_science", "industrial_engineering", "electrical_engineering"
TRACKS = (CS, IEM, EE)

# --------------------------------------------------------------------------
# The word lists below must equal the published rule set, since
# every score and filter is defined in terms of them.
# --------------------------------------------------------------------------

SKILLS = {
    "c++": ("c++", "cpp"),
    "python": ("python",),
    "linux": ("linux", "unix"),
    "git": ("git", "github", "gitlab"),
    "sql": ("sql", "postgresql", "mysql", "sqlite"),
    "docker": ("docker", "container"),
    "kubernetes": ("kubernetes", "k8s"),
    "ci/cd": ("ci/cd", "continuous integration", "jenkins", "github actions"),
    "rest api": ("rest api", "restful", "http api"),
    "data structures": ("data structures", "algorithms"),
    "embedded": ("embedded", "firmware", "rtos", "real-time", "תוכנה משובצת", "מערכות משובצות", "קושחה"),
    "computer vision": ("computer vision", "opencv", "image processing"),
    "machine learning": ("machine learning", "deep learning", "pytorch", "tensorflow"),
    "javascript": ("javascript", "typescript", "node.js", "nodejs"),
    "react": ("react", "next.js", "nextjs"),
    "go": ("golang", "go language"),
    "rust": ("rust",),
    "java": ("java",),
    "c#": ("c#", "c sharp", ".net"),
    "node.js": ("node.js", "nodejs"),
    "angular": ("angular",),
    "vue": ("vue.js", "vuejs"),
    "aws": ("aws", "amazon web services"),
    "gcp": ("gcp", "google cloud platform"),
    "azure": ("azure",),
    "terraform": ("terraform",),
    "ansible": ("ansible",),
    "jenkins": ("jenkins",),
    "kafka": ("kafka",),
    "redis": ("redis",),
    "mongodb": ("mongodb", "mongo db"),
    "elasticsearch": ("elasticsearch", "elastic search"),
    "spring": ("spring boot", "spring framework"),
    "django": ("django",),
    "fastapi": ("fastapi",),
    "flask": ("flask",),
    "pandas": ("pandas",),
    "numpy": ("numpy",),
    "pytorch": ("pytorch",),
    "tensorflow": ("tensorflow",),
    "llm": ("llm", "large language model"),
    "generative ai": ("generative ai", "genai", "gen ai"),
    "computer architecture": ("computer architecture",),
    "verification": ("verification", "uvm", "systemverilog"),
    "fpga": ("fpga",),
    "networking": ("networking", "network protocols"),
    "cybersecurity": ("cybersecurity", "cyber security", "application security"),
    "excel": ("excel", "microsoft excel", "אקסל"),
    "power bi": ("power bi", "powerbi"),
    "tableau": ("tableau",),
    "data analysis": ("data analysis", "data analytics", "ניתוח נתונים", "אנליזה"),
    "erp": ("erp", "enterprise resource planning", "מערכת erp"),
    "sap": ("sap", "sap apo", "sap ibp"),
    "priority": ("priority erp", "priority software", "פריוריטי"),
    "lean": ("lean manufacturing", "lean methodology", "lean"),
    "six sigma": ("six sigma", "6 sigma"),
    "process improvement": ("process improvement", "continuous improvement", "operational excellence", "שיפור תהליכים", "מצוינות תפעולית"),
    "project management": ("project management", "program management", "pmo", "ניהול פרויקטים"),
    "supply chain": ("supply chain", "שרשרת אספקה", "s&op", "siop"),
    "procurement": ("procurement", "strategic sourcing", "purchasing", "רכש"),
    "production planning": ("production planning", "material planning", "demand planning", "scheduling", "תכנון ייצור", "תפ\"י", "תפי"),
    "operations research": ("operations research", "optimization", "linear programming", "חקר ביצועים", "אופטימיזציה"),
    "statistics": ("statistics", "statistical analysis", "סטטיסטיקה"),
    "power query": ("power query",),
    "vba": ("vba", "visual basic for applications"),
    "verilog": ("verilog",),
    "systemverilog": ("systemverilog", "system verilog"),
    "vhdl": ("vhdl",),
    "uvm": ("uvm", "universal verification methodology"),
    "matlab": ("matlab", "simulink"),
    "pcb": ("pcb", "board design", "altium", "orcad", "cadence allegro"),
    "analog design": ("analog design", "mixed signal", "mixed-signal"),
    "rf": ("rf", "radio frequency", "rfic"),
}

SENIORITY_LEVELS = {
    "student": ("student", "intern", "internship", "סטודנט"),
    "entry level": ("entry level", "graduate", "new grad", "בוגר", "ללא ניסיון"),
    "junior": ("junior", "jr.", "jr ", "ג׳וניור"),
    "mid level": ("mid level", "mid-level", "intermediate"),
    "senior": ("senior", "sr.", "sr ", "סניור"),
    "lead": ("lead engineer", "team lead", "technical lead", "ראש צוות"),
    "staff": ("staff engineer", "principal", "architect"),
    "manager": ("engineering manager", "manager", "director", "מנהל"),
}

SENIOR_TERMS = (
    "senior", "staff", "principal", "lead engineer", "team lead", "engineering manager", "director",
    "architect", "ראש צוות", "מנהל פיתוח",
)

ENTRY_TERMS = (
    "junior", "graduate", "new grad", "entry level", "student", "intern", "בוגר", "ללא ניסיון",
)

DEV_TERMS = (
    "software", "developer", "engineer", "backend", "automation", "infrastructure", "tools", "embedded",
    "integration", "r&d", "research", "algorithm",
)

CS_STRONG_TITLES = (
    "software engineer", "software developer", "software architect", "sw engineer", "sw developer",
    "sw automation", "developer", "backend", "back-end", "frontend", "front-end", "full stack", "fullstack",
    "web developer", "mobile developer", "android developer", "ios developer", "devops", "site reliability",
    "sre", "cloud engineer", "platform engineer", "data engineer", "data scientist", "data science",
    "machine learning", "deep learning", "ml engineer", "ai engineer", "algorithm", "computer vision",
    "vision language", "nlp", "cyber", "security engineer", "security researcher", "security analyst",
    "ai security", "application security", "penetration tester", "dfir", "qa engineer", "qa automation",
    "automation developer", "test automation", "embedded software", "embedded developer", "embedded fw",
    "firmware", "software integration", "tech lead", "systems programmer", "system programmer",
    "system administrator", "systems administrator", "sysadmin", "database engineer", "network engineer",
    "dba", "solutions architect", "cloud architect", "data architect", "security architect",
    "network architect", "networking architect", "platform architect", "solutions engineer", "מהנדס תוכנה",
    "מהנדסת תוכנה", "מפתח תוכנה", "מפתחת תוכנה", "פיתוח תוכנה", "מתכנת", "מתכנתת", "פול סטאק", "בקאנד",
    "פרונטאנד", "אלגוריתם", "אלגוריתמים", "למידת מכונה", "בינה מלאכותית", "מדען נתונים", "מדענית נתונים",
    "מהנדס נתונים", "מהנדסת נתונים", "אבטחת מידע", "סייבר", "חוקר אבטחה", "חוקרת אבטחה", "אוטומציה", "קושחה",
    "תוכנה משובצת", "אינטגרציית תוכנה",
)

CS_CONTEXT = (
    "computer science", "software engineering", "software", "python", "java", "javascript", "typescript",
    "c++", "c#", "golang", "react", "node.js", "linux", "kubernetes", "docker", "aws", "azure", "gcp", "sql",
    "distributed systems", "microservices", "machine learning", "deep learning", "computer vision",
    "data structures", "algorithms", "embedded software", "real-time software", "cyber security",
    "מדעי המחשב", "הנדסת תוכנה", "פיתוח תוכנה", "תוכנה", "אלגוריתמים", "למידת מכונה", "בינה מלאכותית",
    "מערכות הפעלה", "אבטחת מידע", "סייבר",
)

CS_GENERIC_TITLES = (
    "engineer", "developer", "programmer", "researcher", "scientist", "analyst", "מהנדס", "מהנדסת", "מפתח",
    "מפתחת", "חוקר", "חוקרת", "מדען", "מדענית",
)

CS_OTHER_DISCIPLINE_TITLES = (
    "electrical engineer", "electrical engineering", "electronics engineer", "electronics engineering",
    "computer engineer", "computer engineering", "hardware engineer", "mechanical engineer",
    "physical design", "silicon design", "board design", "rf engineer", "manufacturing engineer",
    "production engineer", "quality engineer", "chemical engineer", "מהנדס חשמל", "מהנדסת חשמל", "הנדסת חשמל",
    "מהנדס חומרה", "מהנדסת חומרה", "הנדסת מחשבים", "מהנדס מחשבים", "מהנדסת מחשבים", "מהנדס מכונות",
    "מהנדסת מכונות", "הנדסת מכונות", "מהנדס ייצור", "מהנדסת ייצור",
)

CS_HARDWARE_TITLES = (
    "dft", "design for test", "design verification", "verification engineer", "fpga", "rtl", "asic", "vlsi",
    "logic design", "circuit design", "circuit engineer", "physical design", "sta engineer", "static timing",
    "timing engineer", "silicon design", "silicon validation", "chip design", "chip engineer", "hardware",
    "hw emulation", "hardware emulation", "soc test", "soc validation", "post-silicon", "pre-silicon",
    "power integrity", "signal integrity", "board design", "cpu architect", "processor architect",
    "chip architect", "soc architect", "computer architecture", "pcb", "analog", "mixed signal",
    "mixed-signal", "rfic", "rf engineer", "optical", "electro-optic", "electro optic",
    "wireless connectivity system",
)

CS_HARDWARE_CONTEXT = (
    "electrical engineering", "electronics engineering", "computer engineering", "semiconductor", "silicon",
    "chip development", "chip design", "rtl", "asic", "fpga", "vlsi", "systemverilog", "verilog", "uvm",
    "dft", "atpg", "mbist", "jtag", "physical design", "static timing", "timing analysis", "circuit",
    "transistor", "power integrity", "signal integrity", "pcb", "board design", "rfic", "mixed signal",
    "mixed-signal", "pre-silicon", "post-silicon", "soc", "שבבים", "סיליקון", "הנדסת חשמל", "הנדסת מחשבים",
    "חומרה",
)

CS_SOFTWARE_TITLES = (
    "software", "firmware", "embedded software", "sw engineer", "sw developer", "developer", "programmer",
    "devops", "site reliability", "sre", "cloud engineer", "platform engineer", "data engineer",
    "data scientist", "machine learning", "ml engineer", "ai engineer", "frontend", "front-end", "full stack",
    "fullstack", "תוכנה", "קושחה", "מפתח", "מפתחת", "מתכנת", "מתכנתת",
)

IEM_STRONG_TITLES = (
    "industrial engineer", "industrial engineering", "business analyst", "data analyst", "bi analyst",
    "operations analyst", "supply chain", "production planner", "material planner", "demand planner",
    "planning analyst", "procurement", "buyer", "sourcing", "logistics", "pmo", "project manager",
    "program manager", "project coordinator", "process improvement", "operational excellence",
    "continuous improvement", "manufacturing engineer", "production engineer", "quality engineer",
    "sales operations", "business operations", "product operations", "revenue operations", "inventory",
    "capacity planning", "production control", "operations planner", "מהנדס תעשייה", "מהנדסת תעשייה",
    "תעשייה וניהול", "תכנון ובקרה", "תפ\"י", "תפי", "פלנר", "פלנרית", "שרשרת אספקה", "רכש", "לוגיסטיקה",
    "ניהול פרויקטים", "מנהל פרויקט", "מנהלת פרויקט", "מוביל פרויקט", "מובילת פרויקט", "שיפור תהליכים",
    "מצוינות תפעולית", "ארגון ושיטות", "אנליסט", "אנליסטית", "תכנון ייצור", "בקרת ייצור", "כלכלן", "כלכלנית",
    "תקציב ובקרה", "מנהל.ת רכש", "מנהל.ת לוגיסטיקה",
)

IEM_CONTEXT = (
    "industrial engineering", "operations", "supply chain", "manufacturing", "planning", "planner",
    "procurement", "logistics", "inventory", "erp", "sap", "mrp", "s&op", "siop", "lean", "six sigma",
    "process improvement", "continuous improvement", "kpi", "power bi", "excel", "data analysis",
    "production", "capacity", "scheduling", "תעשייה וניהול", "תפעול", "שרשרת אספקה", "רכש", "לוגיסטיקה",
    "תכנון", "ייצור", "תפ\"י", "תפי", "אקסל", "מערכות מידע",
)

IEM_GENERIC_TITLES = (
    "analyst", "operations", "project", "program", "planner", "planning", "coordinator", "quality",
    "business", "strategy", "אנליסט", "פרויקט", "תפעול", "תכנון", "איכות",
)

IEM_LABOUR_TITLES = (
    "warehouse worker", "warehouse associate", "picker", "order picker", "store associate", "מחסנאי",
    "מחסנאית", "מחסנאים", "מלקט", "מלקטת", "מלקטים",
)

EE_STRONG_TITLES = (
    "electrical engineer", "hardware engineer", "hardware design", "fpga", "asic", "vlsi",
    "verification engineer", "design verification", "chip design", "silicon", "soc", "rtl",
    "embedded engineer", "firmware engineer", "board design", "analog engineer", "mixed signal",
    "rf engineer", "rfic", "signal integrity", "power electronics", "electronic engineer", "מהנדס חשמל",
    "מהנדסת חשמל", "מהנדס חומרה", "מהנדסת חומרה", "וריפיקציה", "תכנון כרטיסים", "אלקטרואופטיקה", "אלקטרוניקה",
    "מהנדס.ת חשמל", "מהנדס.ת חומרה", "מהנדס.ת אלקטרוניקה", "תוכנת נתב", "קושחה", "מכטרוניקה",
    "electro-optics", "electro optics", "optics", "silicon validation", "design emulation", "system test",
    "wifi", "wi-fi", "soc architect", "circuit design", "logic design",
)

EE_CONTEXT = (
    "verilog", "systemverilog", "vhdl", "uvm", "fpga", "asic", "rtl", "vlsi", "soc", "pcb", "embedded",
    "firmware", "microcontroller", "electronics", "electrical engineering", "hardware", "analog",
    "mixed signal", "rf", "signal integrity", "cadence", "altium", "matlab", "simulink", "חשמל", "אלקטרוניקה",
    "חומרה", "קושחה", "אלקטרואופטיקה", "מכטרוניקה", "עיבוד אות",
)

KNOWN_COMPANIES = {
    "google": ("google", "alphabet"),
    "apple": ("apple",),
    "microsoft": ("microsoft",),
    "amazon": ("amazon",),
    "meta": ("meta", "facebook"),
    "netflix": ("netflix",),
    "nvidia": ("nvidia",),
    "openai": ("openai",),
    "stripe": ("stripe",),
    "tesla": ("tesla",),
    "salesforce": ("salesforce",),
    "adobe": ("adobe",),
    "oracle": ("oracle",),
    "uber": ("uber",),
    "airbnb": ("airbnb",),
    "linkedin": ("linkedin",),
    "applied materials": ("applied materials",),
    "kla": ("kla",),
    "medtronic": ("medtronic",),
    "intel": ("intel",),
    "mobileye": ("mobileye",),
    "elbit systems": ("elbit",),
    "rafael": ("rafael",),
    "iai": ("israel aerospace", "iai"),
    "philips": ("philips",),
}

ROLE_FAMILIES = {
    "computer_science": {
        "software": ("software", "developer", "programmer", "פיתוח תוכנה", "מפתח", "מתכנת"),
        "backend": ("backend", "back-end", "server side", "בקאנד"),
        "frontend": ("frontend", "front-end", "react", "פרונטאנד"),
        "full_stack": ("full stack", "fullstack", "פול סטאק"),
        "embedded": ("embedded", "firmware", "rtos", "קושחה", "תוכנה משובצת"),
        "devops": ("devops", "sre", "site reliability", "platform engineer", "cloud engineer"),
        "data": ("data engineer", "data scientist", "data science", "database engineer"),
        "ml_ai": ("machine learning", "deep learning", "ai engineer", "computer vision", "nlp", "אלגוריתם", "למידת מכונה"),
        "cyber": ("cyber", "security engineer", "security researcher", "dfir", "penetration", "סייבר", "אבטחת מידע"),
        "qa_automation": ("qa engineer", "qa automation", "test automation", "automation engineer"),
    },
    "electrical_engineering": {
        "rtl_vlsi": ("rtl", "vlsi", "verilog", "chip design"),
        "verification": ("verification", "uvm", "design verification", "emulation"),
        "fpga_asic": ("fpga", "asic", "soc"),
        "hardware": ("hardware", "board design", "pcb", "circuit", "חומרה", "כרטיסים"),
        "rf": ("rf", "rfic", "radio frequency", "microwave", "מיקרוגל"),
        "signal_processing": ("signal processing", "dsp", "עיבוד אות"),
        "embedded": ("embedded", "firmware", "rtos", "קושחה"),
        "semiconductor": ("silicon", "semiconductor", "physical design", "analog", "mixed signal"),
        "electro_optics": ("electro-optics", "electro optics", "optics", "אלקטרואופטיקה"),
    },
    "industrial_engineering": {
        "data_bi": ("data analyst", "bi analyst", "business intelligence", "power bi", "אנליסט"),
        "operations": ("operations", "operational", "תפעול"),
        "process": ("process improvement", "continuous improvement", "lean", "שיפור תהליכים"),
        "pmo_project": ("pmo", "project manager", "program manager", "project coordinator", "ניהול פרויקט", "פרויקט"),
        "supply_chain": ("supply chain", "procurement", "buyer", "planner", "logistics", "inventory", "רכש", "לוגיסטיקה", "פלנר", "תפ\"י"),
        "business_analysis": ("business analyst", "product analyst", "operations analyst", "כלכלן"),
        "information_systems": ("information systems", "erp", "sap", "מערכות מידע"),
        "quality_production": ("quality engineer", "manufacturing engineer", "production engineer", "איכות", "ייצור"),
    },
}

REGION_PATTERNS = (
    r"\bisrael\b", "ישראל", r"\btel[\s\-–—]*aviv(?:[\s\-–—]*yafo)?\b", r"תל[\s\-–—]*אביב(?:[\s\-–—]*יפו)?",
    r"\bjaffa\b", r"\byafo\b", r"\bhaifa\b", "חיפה", r"\bjerusalem\b", "ירושלים", r"\bherzliya\b",
    r"\bhertzliya\b", r"\bherzlia\b", "הרצליה", r"\bramat[\s\-–—]*gan\b", r"רמת[\s\-–—]*גן",
    r"\bgivata?yim\b", "גבעתיים", r"\brishon[\s\-–—]*le[\s\-–—]*zion\b", r"\brishon[\s\-–—]*lezion\b",
    r"ראשון[\s\-–—]*לציון", r"\bpet(?:ah|ach)[\s\-–—]*tikva\b", r"פתח[\s\-–—]*תקו(?:ו)?ה",
    r"\bra['’]?[\s\-–—]*anana\b", r"\braanana\b", "רעננה", r"\bkfar[\s\-–—]*saba\b", r"כפר[\s\-–—]*סבא",
    r"\bnetanya\b", "נתניה", r"\bbe(?:er|['’]er)[\s\-–—]*sheva\b", r"\bbeersheba\b", r"באר[\s\-–—]*שבע",
    r"\byo?qneam\b", r"\byokneam\b", "יקנעם", r"\bcaesarea\b", "קיסריה",
    r"\bhod[\s\-–—]*ha['’]?[\s\-–—]*sharon\b", r"\bhod[\s\-–—]*hasharon\b", r"הוד[\s\-–—]*השרון",
    r"\brosh[\s\-–—]*ha['’]?[\s\-–—]*ayin\b", r"\brosh[\s\-–—]*haayin\b", r"ראש[\s\-–—]*העין", r"\brehovot\b",
    r"\brechovot\b", "רחובות", r"\bnes[\s\-–—]*ziona\b", r"\bness[\s\-–—]*ziona\b", r"נס[\s\-–—]*ציונה",
    r"\byavne\b", "יבנה", r"\bor[\s\-–—]*yehuda\b", r"אור[\s\-–—]*יהודה", r"\byehud(?:[\s\-–—]*monosson)?\b",
    r"יהוד(?:[\s\-–—]*מונוסון)?", r"\bkiryat[\s\-–—]*ono\b", r"קרי(?:י)?ת[\s\-–—]*אונו", r"\bshoham\b",
    "שוהם", r"\bbnei[\s\-–—]*brak\b", r"בני[\s\-–—]*ברק", r"\bholon\b", "חולון", r"\bbat[\s\-–—]*yam\b",
    r"בת[\s\-–—]*ים", r"\bashdod\b", "אשדוד", r"\bashkelon\b", "אשקלון", r"\bkiryat[\s\-–—]*gat\b",
    r"\bqiryat[\s\-–—]*gat\b", r"קרי(?:י)?ת[\s\-–—]*גת", r"\bmodi['’]?[\s\-–—]*in\b", r"\bmodiin\b",
    "מודיעין", r"\blod\b", "לוד", r"\bramla\b", r"\bramle\b", "רמלה", r"\bnahariya\b", r"\bnahariyya\b",
    "נהריה", r"\bakko\b", r"\bacre\b", "עכו", r"\btiberias\b", "טבריה", r"\beilat\b", "אילת", r"\bnazareth\b",
    "נצרת", r"\bafula\b", "עפולה", r"\bkarmiel\b", "כרמיאל", r"\bkirya?t[\s\-–—]*shmona\b",
    r"קרי(?:י)?ת[\s\-–—]*שמונה", r"\bzichron[\s\-–—]*ya['’]?akov\b", r"זכרון[\s\-–—]*יעקב", r"\bbinyamina\b",
    "בנימינה", r"\bglilot\b", "גלילות", r"\bramat[\s\-–—]*ha['’]?[\s\-–—]*hayal\b", r"רמת[\s\-–—]*החייל",
    r"\bairport[\s\-–—]*city\b", r"איירפורט[\s\-–—]*סיטי", r"\bcentral[\s\-–—]*israel\b",
    r"\bnorthern[\s\-–—]*israel\b", r"\bsouthern[\s\-–—]*israel\b",
)

HEBREW_CITIES = {
    "תל אביב": "Tel Aviv, Israel",
    "תל אביב-יפו": "Tel Aviv, Israel",
    "תל אביב יפו": "Tel Aviv, Israel",
    "חיפה": "Haifa, Israel",
    "הרצליה": "Herzliya, Israel",
    "ירושלים": "Jerusalem, Israel",
    "רמת גן": "Ramat Gan, Israel",
    "פתח תקווה": "Petah Tikva, Israel",
    "פתח תקוה": "Petah Tikva, Israel",
    "קריית גת": "Kiryat Gat, Israel",
    "קרית גת": "Kiryat Gat, Israel",
    "באר שבע": "Be'er Sheva, Israel",
    "יקנעם": "Yokneam, Israel",
    "יוקנעם": "Yokneam, Israel",
    "רחובות": "Rehovot, Israel",
    "נתניה": "Netanya, Israel",
    "קיסריה": "Caesarea, Israel",
    "בני ברק": "Bnei Brak, Israel",
    "ראשון לציון": "Rishon Lezion, Israel",
    "כפר סבא": "Kfar Saba, Israel",
    "הוד השרון": "Hod Hasharon, Israel",
    "מודיעין": "Modiin, Israel",
    "נס ציונה": "Nes Ziona, Israel",
    "אור יהודה": "Or Yehuda, Israel",
    "יהוד": "Yehud, Israel",
    "חולון": "Holon, Israel",
    "לוד": "Lod, Israel",
    "רמלה": "Ramla, Israel",
    "רמת השרון": "Ramat Hasharon, Israel",
    "ראש העין": "Rosh HaAyin, Israel",
    "גבעתיים": "Givatayim, Israel",
    "קריות": "Krayot, Israel",
    "קריית ביאליק": "Kiryat Bialik, Israel",
    "קרית ביאליק": "Kiryat Bialik, Israel",
    "כרמיאל": "Karmiel, Israel",
    "גוש שגב": "Misgav, Israel",
    "משגב": "Misgav, Israel",
}

ENGLISH_CITIES = (
    "Tel Aviv", "Tel Aviv-Yafo", "Haifa", "Herzliya", "Jerusalem", "Ramat Gan", "Petah Tikva", "Kiryat Gat",
    "Beer Sheva", "Be'er Sheva", "Yokneam", "Yoqneam", "Ra'anana", "Raanana", "Rehovot", "Netanya",
    "Caesarea", "Bnei Brak", "Rishon Lezion", "Kfar Saba", "Hod Hasharon", "Modiin", "Nes Ziona", "Or Yehuda",
    "Yehud", "Migdal Haemek", "Migdal Ha'Emek", "Ramat-Gan", "Kiryat Bialik", "Karmiel", "Misgav",
)

GENERIC_DESCRIPTIONS = (
    "apply", "apply now", "view job", "job details", "read more", "learn more", "הגש מועמדות", "לפרטי המשרה",
    "פרטים נוספים",
)

GENERIC_LINK_TITLES = (
    "see full role description", "read more", "read more >", "more info", "more info >", "...read more",
    "…read more", "view job", "job details", "learn more", "apply", "apply now",
)

GENERIC_BATCH_TITLES = (
    "untitled role", "job", "job details", "view job", "apply", "careers", "position", "open position",
)

REQUIRED_MARKERS = (
    "required", "must", "mandatory", "requirement", "at least", "minimum", "חובה", "נדרש", "נדרשת", "נדרשים",
    "דרישות", "לפחות", "ניסיון מוכח",
)

PREFERRED_MARKERS = (
    "preferred", "advantage", "nice to have", "יתרון", "עדיפות",
)

DEGREE_TERMS = (
    "bsc", "b.sc", "bachelor", "degree", "תואר", "מהנדס", "engineering",
)

MANDATORY_TERMS = (
    "security clearance", "סיווג ביטחוני", "certification", "הסמכה",
)

QUESTION_GROUPS = {
    "previous_company_relationship": (("previously", "currently", "ever"), ("employed", "worked", "contracted", "offer"), ("company", "subsidiary", "intel", "employer")),
    "adult": (("18", "legal age", "age of majority"),),
    "non_compete": (("non compete", "restrict", "conflict of interest"), ("agreement", "employment", "obligation")),
    "relative_at_company": (("relative", "family member", "spouse"), ("company", "employed", "work")),
    "previously_applied": (("previously", "ever"), ("applied", "interviewed", "application")),
    "relocation": (("relocate", "relocation"),),
    "travel": (("willing", "able"), ("travel",)),
    "background_check": (("background check", "screening"),),
    "disability": (("disability", "disabled"),),
    "veteran": (("veteran", "military status"),),
    "gender": (("gender", "sex"),),
}

CAREER_SITES = {
    "google": (("google", "alphabet"), "https://careers.google.com"),
    "apple": (("apple",), "https://jobs.apple.com"),
    "microsoft": (("microsoft",), "https://jobs.careers.microsoft.com"),
    "amazon": (("amazon", "aws"), "https://www.amazon.jobs"),
    "meta": (("meta", "facebook"), "https://www.metacareers.com"),
    "nvidia": (("nvidia",), "https://www.nvidia.com/en-us/about-nvidia/careers"),
    "figma": (("figma",), "https://www.figma.com/careers"),
    "redis": (("redis",), "https://redis.io/careers"),
}
CS_DEGREE_SIGNALS = ("computer science", "software engineering", "מדעי המחשב", "הנדסת תוכנה")
EE_DEGREE_SIGNALS = ("electrical engineering", "electronics engineering", "הנדסת חשמל", "הנדסת אלקטרוניקה")
EE_ENGINEER_TITLES = ("engineer", "designer", "developer", "architect", "מהנדס", "מהנדסת")
IEM_DEGREE_SIGNALS = (
    "industrial engineering", "industrial & management engineering", "industrial and management engineering",
    "הנדסת תעשייה וניהול", "תואר ראשון בהנדסת תעשייה",
)
IEM_SOFTWARE_TITLES = ("software quality", "software infrastructure engineer", "מהנדס.ת תשתיות תוכנה")

SENIORITY_RANK = {
    "student": 0, "entry level": 1, "junior": 2, "mid level": 3, "senior": 4, "lead": 5, "staff": 6, "manager": 6,
}
PROFESSION_MANAGERS = ("project manager", "product manager", "program manager")

NO_EXPERIENCE = (
    "no experience", "no prior experience", "no previous experience", "experience not required",
    "no professional experience required", "ללא ניסיון", "ללא נסיון", "אין צורך בניסיון", "אין צורך בנסיון",
    "לא נדרש ניסיון", "לא נדרש נסיון", "new grad", "new graduate",
)
EXPERIENCE_RANGE = r"(\d+(?:\.\d+)?)\s*(?:-|–|—|to)\s*(\d+(?:\.\d+)?)\s*(?:years?|yrs?\.?|שנות|שנים)"
EXPERIENCE_SINGLE = r"(\d+(?:\.\d+)?)\s*(?:\+|or more|plus)?\s*(?:years?|yrs?\.?|שנות|שנים)"
EXPERIENCE_IMPLICIT = (
    r"\bhands[- ]on experience\b", r"\bprofessional experience\b", r"\bcommercial experience\b",
    r"\bindustry experience\b", r"\bwork experience\b",
    r"\bexperience\s+(?:working|developing|building|designing|implementing|using)\b",
    r"\bexperience\s+(?:with|in)\b", r"ני?סיון\s+(?:עבודה|בעבודה)\s+עם", r"ני?סיון\s+מעשי", r"ני?סיון\s+מוכח",
)
EXPERIENCE_OPTIONAL_CUES = (
    "preferred", "advantage", "a plus", "nice to have", "nice-to-have", "bonus", "יתרון", "רצוי", "עדיפות",
)
EXPERIENCE_BUCKETS = ("0", "1", "2", "3", "4", "5+")

EMPLOYMENT_TYPES = {
    "student": ("student", "סטודנט"),
    "internship": ("internship", "intern ", "מתמחה"),
    "part_time": ("part-time", "part time", "משרה חלקית"),
    "temporary": ("temporary", "temp.", "contract", "משרה זמנית", 'החלפה לחל"ד', "החלפה לחלד"),
    "full_time": ("full-time", "full time", "משרה מלאה"),
}

LOCATION_ALIASES = {
    "israel": ("israel", "ישראל"),
    "tel aviv": ("tel aviv", "tel-aviv", "תל אביב", "תל-אביב"),
    "haifa": ("haifa", "חיפה"),
    "jerusalem": ("jerusalem", "ירושלים"),
}
GENERIC_REGION_NAMES = ("israel", "il", "isr")

UPPERCASE_SLUG_WORDS = ("ai", "ml", "qa", "ui", "ux", "hw", "fw", "cad", "dft", "pdv", "sre", "aws")
URL_IDENTITY_PARAMS = ("jid", "jobid", "job_id", "joborderid", "gh_jid", "reqid", "requisitionid", "pi")
SUBMITTED_STATUSES = ("submitted", "phone_screen", "test", "interview", "offer", "accepted", "rejected")
TIER_RANK = {"top_match": 5, "strong_match": 4, "good_match": 3, "low_match": 2, "stretch": 1}

# ATS family -> (can be submitted automatically)
ATS_FAMILIES = {
    "greenhouse": True, "comeet": True, "lever": True, "ashby": True,
    "workday": False, "smartrecruiters": True, "custom": False,
}

# Default search preferences of a track, and the starter skills older profiles were seeded with.
TRACK_DEFAULTS = {
    CS: {
        "desired_titles": ("software engineer", "backend", "r&d", "research engineer", "ai engineer",
                           "machine learning engineer"),
        "preferred_locations": ("Haifa", "Tel Aviv", "Israel", "Remote"),
        "preferred_work_modes": ("hybrid", "remote", "onsite"),
        "keywords": ("C++", "Python", "automation", "infrastructure", "graduate"),
        "excluded_keywords": ("manual qa", "sales", "support representative"),
        "auto_apply_threshold": 82,
    },
    IEM: {
        "desired_titles": ("industrial engineer", "business analyst", "data analyst", "operations analyst",
                           "supply chain", "pmo", "project manager", "production planner", "procurement",
                           "process improvement"),
        "preferred_locations": ("Israel", "Central Israel", "Tel Aviv", "Haifa"),
        "preferred_work_modes": ("hybrid", "onsite", "remote"),
        "keywords": ("industrial engineering", "operations", "supply chain", "planning", "process improvement",
                     "data analysis", "entry level", "junior"),
        "excluded_keywords": ("software engineer", "frontend", "backend", "sales representative", "manual qa"),
        "auto_apply_threshold": 78,
    },
    EE: {
        "desired_titles": ("electrical engineer", "hardware engineer", "fpga engineer", "asic", "vlsi",
                           "verification engineer", "embedded engineer", "firmware engineer", "analog engineer",
                           "rf engineer", "board design"),
        "preferred_locations": ("Israel", "Haifa", "Tel Aviv", "Jerusalem"),
        "preferred_work_modes": ("hybrid", "onsite", "remote"),
        "keywords": ("electrical engineering", "hardware", "fpga", "asic", "verification", "embedded", "firmware",
                     "graduate", "junior"),
        "excluded_keywords": ("frontend", "full stack", "sales representative", "manual qa"),
        "auto_apply_threshold": 80,
    },
}
STARTER_SKILLS = {
    CS: ("C++", "Python", "Git", "Linux", "Data Structures", "REST API"),
    IEM: ("Excel", "SQL", "Power BI", "Data Analysis", "ERP", "SAP", "Process Improvement", "Project Management"),
    EE: ("C", "C++", "Python", "Verilog", "SystemVerilog", "VHDL", "FPGA", "UVM", "Embedded", "Linux", "MATLAB",
         "PCB"),
}
