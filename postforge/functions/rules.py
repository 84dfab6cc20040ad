"""Rule tables. Everything in this module is a fixed value: results depend on the exact words, patterns and their order."""

from __future__ import annotations

US_STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA",
    "WA", "WV", "WI", "WY", "DC",
]
CA_PROVINCES = ["AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT"]

US_CITIES = [
    "san francisco", "new york", "new york city", "austin", "seattle", "chicago", "boston", "denver", "los angeles", "miami", "portland",
    "washington dc", "south san francisco", "atlanta",
]
CA_CITIES = [
    "toronto", "vancouver", "montreal", "montréal", "calgary", "ottawa", "waterloo", "mississauga", "markham", "quebec city", "saskatoon",
    "winnipeg", "hamilton", "burnaby", "surrey", "halifax", "edmonton", "regina", "kitchener", "london, on", "brampton", "scarborough",
    "richmond, bc", "laval", "longueuil", "gatineau", "sherbrooke", "barrie", "st. john", "thunder bay", "kelowna", "victoria, bc",
    "fredericton", "moncton", "charlottetown", "north york", "etobicoke", "kanata", "oakville", "burlington, on", "guelph", "saint-laurent",
    "dorval", "grande prairie", "red deer", "lethbridge", "nanaimo", "kamloops", "prince george", "saint john", "trois-rivières", "saguenay",
    "lévis", "terrebonne", "brossard", "repentigny", "newmarket", "richmond hill", "vaughan", "ajax", "whitby", "oshawa", "pickering",
    "cambridge, on", "kingston, on", "sudbury", "peterborough, on", "brantford", "st. catharines", "niagara falls, on", "chatham, on", "sarnia",
    "windsor, on", "coquitlam", "langley", "abbotsford", "new westminster", "north vancouver", "west vancouver", "delta, bc", "maple ridge",
    "chilliwack", "courtenay", "comox", "whistler", "squamish", "acheson",
]
CONTINENT_PHRASES = ["NORTH AMERICA", "AMERICAS", "US & CANADA", "US/CANADA", "US AND CANADA"]
US_PHRASES = ["UNITED STATES", "USA", "U.S."]
REMOTE_PHRASES = ["REMOTE", "WORK FROM HOME", "WORLDWIDE", "ANYWHERE"]
REMOTE_ELSEWHERE = [
    "EUROPE", "EMEA", "LATAM", "APAC", "ASIA", "AUSTRALIA", "INDIA", "AFRICA", "MIDDLE EAST", "UNITED KINGDOM", "GERMANY", "FRANCE", "BRAZIL",
    "JAPAN", "SINGAPORE", "NETHERLANDS", "SWEDEN", "POLAND",
]

TITLE_STOP_WORDS = ["senior", "sr", "sr.", "junior", "jr", "jr.", "staff", "principal", "ii", "iii", "iv", "intern"]
TEXT_STOP_WORDS = [
    "the", "and", "for", "with", "you", "your", "our", "are", "will", "that", "this", "from", "have", "has", "about", "job", "team", "role",
    "work", "experience", "years", "skills", "ability",
]

STABLE_QUERY_PARAMS = [
    "gh_jid", "job", "jobid", "job_id", "jobreqid", "requisitionid", "requisition_id", "reqid", "req_id", "posting", "postingid", "posting_id",
]
DIRECT_PREFIXES = ["Ashby", "Greenhouse", "Lever", "Recruitee", "Rippling", "SmartRecruiters", "SuccessFactors", "Taleo", "Workable", "Workday", "iCIMS"]
BOARD_PREFIXES = ["Himalayas", "JobBank", "TheMuse", "USAJobs"]
AGGREGATOR_PREFIXES = ["Adzuna", "Jobicy", "RemoteOK", "Remotive"]
DIRECT_HOSTS = [
    "ashbyhq.com", "greenhouse.io", "lever.co", "recruitee.com", "ats.rippling.com", "smartrecruiters.com", "successfactors.com",
    "successfactors.eu", "taleo.net", "apply.workable.com", "myworkdayjobs.com", "icims.com",
]
BOARD_HOSTS = ["himalayas.app", "jobbank.gc.ca", "themuse.com", "usajobs.gov"]
AGGREGATOR_HOSTS = ["adzuna.com", "jobicy.com", "remoteok.com", "remotive.com", "lensa.com"]
TRUSTED_SOURCE = r"^(Ashby|Greenhouse|Lever|Recruitee|Rippling|SmartRecruiters|SuccessFactors|Workday):"
DEMO_SOURCES = ["BoardAggregator-X", "CompanyCareer-Direct", "PartnerAPI-Alpha"]

# portals: words in the source's name, words in the apply URL
STRUCTURED_PORTALS = (
    ["greenhouse", "lever", "ashby", "workday", "smartrecruiters", "icims", "workable", "rippling", "recruitee"],
    ["greenhouse.io", "lever.co", "ashbyhq.com", "myworkdayjobs.com", "smartrecruiters.com", "icims.com", "apply.workable.com", "ats.rippling.com", "recruitee.com"],
)
SEMI_PORTALS = (["successfactors", "taleo", "usajobs"], ["successfactors.com", "taleo.net", "usajobs.gov"])
AGGREGATOR_PORTALS = ["adzuna", "himalayas", "themuse", "remoteok", "remotive", "jobicy", "jobbank"]
KNOWN_REDIRECTS = ["greenhouse", "lever.co", "ashbyhq.com", "myworkdayjobs.com", "smartrecruiters.com", "icims.com"]
CUSTOM_WRITING = "cover letter|essay|statement of interest|why do you want|why are you interested|additional question|writing sample"
HIGH_TOUCH_TITLE = r"\b(manager|director|principal|staff\s+engineer|distinguished|fellow|chief|cto|cfo|coo|vp\b|vice president|head of)\b"
INTERN_TITLE = r"\b(intern|co-op|coop|internship|stagiaire)\b"

JUNK_TITLES = [
    r"^(jobs?|job search|search results|career opportunities|careers?|open positions?|job openings?)$",
    r"^(page not found|404|access denied|forbidden|sign in|log in)$",
]
JUNK_CONTENT = [
    r"\b(access denied|forbidden|captcha|cloudflare|security check|enable javascript|page not found|404 not found)\b",
    r"\b(sign in to continue|log in to continue|session expired)\b",
]
JOB_SIGNALS = r"\b(responsibilities|requirements|qualifications|what you(?:'|’)ll do|what we(?:'|’)re looking for|benefits|compensation|about the role|about the job|job description)\b"
DEAD_CONTENT = [
    r"\b(job (?:posting )?(?:has )?(?:closed|expired)|position has been filled|role has been filled|no longer accepting applications)\b",
    r"\b(this posting is no longer available|this job is no longer available|application window has closed)\b",
    r"\b(job not found|posting not found|position not found|requisition not found|listing not found)\b",
    r"\b(position (?:is )?(?:closed|filled)|posting (?:is )?(?:closed|inactive)|role (?:is )?no longer open)\b",
    r"\b(we (?:are|re) no longer accepting applications|this opportunity is no longer open|this requisition has been cancelled)\b",
]

INTERNSHIP_WORDS = ["internship", "intern", "co-op", "co op", "coop", "summer student", "student intern", "student placement", "work term", "placement student"]
ENTRY_TITLE = [
    "entry-level", "entry level", "new grad", "new graduate", "recent graduate", "graduate program", "graduate role", "campus hire",
    "university hire", "early career", "apprentice", "trainee", "rotational program",
]
ENTRY_TEXT = [*ENTRY_TITLE, "no prior experience", "0-2 years", "0 to 2 years", "1-2 years", "1 to 2 years", "up to 2 years"]
ASSOCIATE_TITLE = ["associate", "junior", "jr.", " jr ", "associate-level", "junior-level", "junior level"]
ASSOCIATE_TEXT = ["associate level", "junior level", "junior-level", "2-4 years", "2 to 4 years", "3-5 years", "3 to 5 years"]
SENIOR_TITLE = [
    "senior", "sr.", " sr ", "staff", "principal", "lead", "manager", "supervisor", "head of", "director", "vice president", "vp ", " vp",
    "chief", "president",
]
SENIOR_TEXT = [
    "senior-level", "leadership role", "leadership experience", "people management", "management experience", "5+ years", "6+ years",
    "7+ years", "8+ years", "10+ years",
]
ADMIN_TITLE = [
    "executive assistant", "administrative assistant", "administrative coordinator", "administrative specialist", "administrative support",
    "office manager", "office administrator", "office coordinator", "admin assistant", "receptionist", "scheduler",
]
ADMIN_TEXT = ["administrative support", "executive support", "calendar management", "travel arrangements", "expense reports", "office administration"]
ADMIN_FAMILY = ["administrative"]
EXECUTIVE_WORDS = ["chief", "vice president", "vp ", " vp", "president", "head of", "director"]
EXECUTIVE_TEXT = ["executive leadership", "director-level"]
LEAD_WORDS = ["staff", "principal", "lead", "manager", "supervisor"]
LEAD_TEXT = ["people management", "management experience"]
SENIOR_WORDS = ["senior", "sr.", " sr "]
MID_WORDS = ["mid", "mid-level", "mid level", "intermediate"]
MID_TEXT = ["mid-level", "mid level", "intermediate level"]

# industry, role family, words of the title; the first that matches wins
ROLES = [
    ("TECH", "Solutions Engineering", r"solutions engineer|sales engineer|solutions consultant|pre-sales engineer|implementation engineer|integration engineer|customer engineer"),
    ("TECH", "Solutions Architecture", r"solutions architect|enterprise architect|technical architect|cloud architect|staff architect|principal architect|resident engineer|infrastructure architect|security architect|network architect|data architect"),
    ("TECH", "Product Management", r"product manager|product management|group product manager|senior product manager|staff product manager|principal product manager|technical program manager|program manager|tpm"),
    ("TECH", "Project Management", r"project manager|scrum master|agile coach|release manager|delivery manager|project management|program management|pmo"),
    ("TECH", "Research", r"research scientist|research engineer|researcher|applied research scientist"),
    ("TECH", "Data Science", r"machine learning|ml engineer|data scientist|data science|applied scientist|ai engineer|artificial intelligence"),
    ("TECH", "Data Engineering", r"data engineer|etl engineer|data pipeline engineer|data platform engineer|database engineer|database developer"),
    ("TECH", "Data Analyst", r"data analyst|analytics engineer|business intelligence|bi analyst|data analytics|bi developer|reporting analyst"),
    ("TECH", "Product Analyst", r"product analyst"),
    ("TECH", "Business Analyst", r"business analyst|business systems analyst|systems analyst"),
    ("TECH", "Security", r"security|cybersecurity|cyber security"),
    ("TECH", "QA", r"qa|quality assurance|test automation|sdet|quality engineer|test engineer"),
    ("TECH", "IT Operations", r"it manager|it director|it specialist|it analyst|it operations|systems administrator|system administrator|sysadmin|database administrator|dba|network administrator|help desk|helpdesk|it support|it technician|network engineer|infrastructure manager|it infrastructure"),
    ("TECH", "Marketing", r"product marketing|growth marketing|performance marketing|content marketing|marketing manager|demand generation|marketing analyst|field marketing|digital marketing|brand marketing|marketing operations|lifecycle marketing|marketing lead|marketing director|marketing intern|marketing coordinator|marketing specialist|brand ambassador|marketer|marketing"),
    ("TECH", "Technical Writing", r"technical writer|developer relations|developer advocate|devrel|developer experience|documentation engineer|technical documentation|technical editor|community engineer"),
    ("TECH", "Design", r"designer|design lead|design director|ux design|ui design|product design|brand design|graphic design|visual design|interaction design|design manager|ux researcher"),
    ("TECH", "Customer Success", r"customer success|customer success manager|customer success engineer|technical account manager|technical support engineer|support engineer|customer engineer|implementation consultant|onboarding specialist"),
    ("TECH", "SWE", r"software|frontend|front-end|back\s*end|back-end|full[- ]stack|platform engineer|platform engineering|platform developer|mobile|ios|android|devops|dev ops|site reliability|sre|web engineer|web developer|cloud engineer|infrastructure engineer|systems engineer|reliability engineer|build engineer|release engineer|automation engineer|engineer|engineering manager|dx engineer|content engineer|design engineer|embedded|firmware|developer|développeur|ingénieur(?:\s+logiciel)?"),
    ("FINANCE", "Financial Analyst", r"financial analyst|corporate finance|finance analyst|treasury|finance manager|finance director|controller|comptroller"),
    ("FINANCE", "FP&A", r"fp&a|financial planning|finance.{0,5}strategy|strategy.{0,5}finance"),
    ("FINANCE", "Accounting", r"accountant|accounting|accounting manager|fund accountant|tax analyst|tax manager|auditor|audit manager|bookkeeper|accounts payable|accounts receivable|cpa"),
    ("FINANCE", "Quantitative Finance", r"quantitative analyst|quant analyst|quant developer|quantitative developer|quantitative researcher|quant researcher|trader|trading analyst|trading desk|portfolio manager|portfolio analyst|fund manager|asset manager|investment analyst"),
    ("FINANCE", "Actuarial", r"actuary|actuarial|underwriter|underwriting|claims analyst|insurance analyst|loss adjuster"),
    ("FINANCE", "Investment Banking", r"investment banking|investment bank"),
    ("FINANCE", "Banking", r"loan officer|mortgage|loan analyst|credit analyst|banking|banker|bank manager|branch manager|teller|relationship manager|commercial banker|private banker|personal banker"),
    ("FINANCE", "Risk", r"risk"),
    ("FINANCE", "Compliance", r"compliance|aml|anti-money laundering|kyc|know your customer|regulatory"),
    ("FINANCE", "Credit", r"credit"),
    ("FINANCE", "Wealth Management", r"wealth management|wealth|financial advisor|financial planner|financial planning"),
    ("FINANCE", "Operations", r"operations analyst|biz ops|bizops|business operations|operations manager|operations director|operations"),
    ("TECH", "Sales", r"account executive|sales manager|sales director|sales representatives?|sales lead|inside sales|outside sales|sales operations|revenue manager|revenue operations|sales development|sdr\b|bdr\b|business development representative|enterprise sales|regional sales|national sales|sales analyst|sales enablement|channel sales|partner sales|sales consultant|inbound sales|sales executive|sales team|sales trainer|vendeur|vendeuse|ventes|représentant.*ventes?"),
    ("TECH", "Business Development", r"business development|partnerships manager|partnerships director|strategic partnerships|partner manager|alliances manager|channel manager|bd manager"),
    ("TECH", "Consulting", r"consultant|consulting|advisory|practice lead|practice manager|engagement manager|managing consultant|principal consultant|senior consultant"),
    ("FINANCE", "Legal", r"attorney|lawyer|counsel|general counsel|paralegal|legal analyst|legal operations|legal manager|contracts manager|contract manager|ip counsel|corporate counsel|legal director"),
    ("TECH", "Supply Chain", r"supply chain|procurement|purchasing|logistics manager|logistics analyst|sourcing manager|sourcing analyst|inventory manager|demand planner|supply planner|materials manager|vendor manager"),
    ("TECH", "Communications", r"communications manager|communications director|public relations|pr manager|corporate communications|internal communications|media relations|investor relations"),
    ("TECH", "Administrative", r"executive assistant|administrative assistant|office manager|office administrator|chief of staff|admin assistant|administrative coordinator"),
    ("TECH", "Technical", r"quality inspector|quality control|environmental.*(?:analyst|monitor|specialist|engineer)|lab(?:oratory)?\s+(?:technician|analyst|assistant)|test(?:er|ing)\b|quality assurance.*(?:analyst|inspector)|maintenance.*(?:engineer|leader|manager|technician)|plant.*(?:manager|engineer)|controls\s+(?:engineer|technician)|field\s+(?:engineer|technician)|process\s+engineer|chemical\s+engineer|mechanical\s+(?:engineer|designer)|electrical\s+engineer|civil\s+engineer|structural\s+engineer|manufacturing\s+engineer|industrial\s+engineer|biostatistic|statistician|scientist|researcher|research\s+(?:analyst|assistant|associate)|webmestre|webmaster"),
    ("TECH", "Internship", r"intern\b|internship|co-?op\b|stagiaire|summer\s+student|work\s+(?:term|placement)"),
    ("TECH", "General Professional", r"manager|director|analyst|coordinator|specialist|advisor|officer|lead\b|head of|vp\b|vice president|associate|supervisor|administrator|strategist|planner|representative|clerk|technologist|receptionist|technician|assistant|operator|programmer|buyer|reviewer|trainer|consultant|executive|gestionnaire|analyste|conseill(?:er|ère)|comptable|responsable|coordonnateur|coordonnatrice|technicien(?:ne)?|agent(?:e)?|préposé|commis|adjoint(?:e)?|directeur|directrice|gérant(?:e)?|courtier|inspecteur|opérateur|webmestre|merchant|ambassador"),
]

COMPANY_SUFFIX = r"\b(?:incorporated|inc|corporation|corp|company|co|limited|ltd|llc|ulc|llp|lp|plc|gmbh|ulc|holdings?)\.?$"
COMPANY_PREFIX = r"^(?:company\s+\d+\s*-\s*|[a-z]{1,3}\d{2,}\s+|\d{4,}\s+|canada:\s*)"

COMPANY_SKIP = (
    r"\brecruit(?:er|ers|ing|ment)\b|\bstaff(?:ing)?\b|\bheadhunt(?:er|ing)?\b|\bagency\b|\bjobgether\b|\bmercor\b|\bactalent\b|\bnearsource\b|\bmaarut\b|"
    r"\bemergitel\b|\btalentsphere\b|\bflexstaf\b|\binner circle agency\b|\bnewfound recruiting\b|\bswim recruiting\b|\bstarboard recruitment\b|"
    r"\btechbiz global\b|\bwelcome to the jungle\b"
)

SALARY_WORDS = r"\b(salary|compensation|pay(?:\s+range|\s+details|\s+rate)?|base pay|base salary|hourly rate|hourly wage|rate of pay|annual salary|annualized|ote|on-target earnings?)\b"
MONEY_HINT = r"(?:[$€£]|(?:USD|CAD|EUR|GBP|AUD|NZD|US\$|CA\$|C\$)\b)"
RANGE_HINT = r"(?:[$€£]|\b(?:USD|CAD|EUR|GBP|AUD|NZD|US\$|CA\$|C\$)\b)?\s*\d[\d,]*(?:\.\d+)?\s*[kKmM]?\s*(?:-|–|—|to)\s*(?:[$€£]|\b(?:USD|CAD|EUR|GBP|AUD|NZD|US\$|CA\$|C\$)\b)?\s*\d[\d,]*(?:\.\d+)?\s*[kKmM]?"
NOT_SALARY = r"\b(assets under management|aum|market cap|valuation|funding|runway|revenue|arr|users|ideas saved|billion in assets|million users)\b"
PERIODS = [
    (2080, r"\b(per\s+hour|/\s*hour|hourly|per\s+hr|/\s*hr)\b"),
    (260, r"\b(per\s+day|/\s*day|daily)\b"),
    (52, r"\b(per\s+week|/\s*week|weekly)\b"),
    (12, r"\b(per\s+month|/\s*month|monthly)\b"),
    (1, r"\b(per\s+year|/\s*year|annually|annual|yearly|base salary range)\b"),
]
AMOUNT = r"(?:[$€£]|(?:USD|CAD|EUR|GBP|AUD|NZD|US\$|CA\$|C\$)\s*)?\s*(\d[\d,]*(?:\.\d+)?)\s*([kKmM])?"
SALARY_LEAST, SALARY_MOST = 10_000, 5_000_000

# links that may be shown: source prefixes and hosts that are verified, hosts that never are
TRUSTED_PREFIXES = [
    "Adzuna", "Ashby", "Greenhouse", "Himalayas", "iCIMS", "Jobicy", "Lever", "Remotive", "TheMuse", "Recruitee", "RemoteOK", "Rippling", "SuccessFactors", "SmartRecruiters", "Taleo", "USAJobs", "Workable", "Workday",
]
TRUSTED_HOSTS = [
    "icims.com", "jobs.ashbyhq.com", "boards.greenhouse.io", "job-boards.greenhouse.io", "himalayas.app", "jobicy.com", "jobs.lever.co", "remotive.com", "recruitee.com", "ats.rippling.com", "successfactors.com", "successfactors.eu",
    "jobs.smartrecruiters.com", "myworkdayjobs.com", "taleo.net", "remoteok.com", "themuse.com", "www.themuse.com", "usajobs.gov", "apply.workable.com", "adzuna.com",
]
BLOCKED_HOSTS = ["boardaggregator-x.com", "companycareer-direct.com", "partnerapi-alpha.com"]

# answers of a source or page by HTTP status
GONE_STATUSES = [404, 410]
DEAD_STATUSES = [404, 410, 451]
BLOCKING_STATUSES = [401, 403, 429]
PASSING_STATUSES = [408, 500, 502, 503, 504]
#: Boards whose "not found" is final.
EXACT_BOARDS = ["greenhouse", "lever", "ashby"]

CAREER_WORDS = "(careers?|jobs?|opportunit(?:y|ies)|join-us|work-with-us|employment|talent|openings?|open[- ]roles?|vacanc(?:y|ies))"
NO_PAGE = r"\.(?:pdf|jpg|jpeg|png|gif|svg|webp|ico|css|js|xml|json|rss|zip|mp4|mp3)$"

# a form label's concept; the first that matches wins
LABELS = [
    ("first_name", r"\bfirst\s*name\b"),
    ("last_name", r"\blast\s*name\b|surname\b|family\s*name\b"),
    ("full_name", r"\bfull\s*name\b|\byour\s*name\b"),
    ("email", r"\be[\s-]*mail\b"),
    ("phone", r"\bphone\b|\bmobile\b|\bcell\b|\btelephone\b"),
    ("linkedin_url", r"\blinkedin\b"),
    ("github_url", r"\bgithub\b"),
    ("portfolio_url", r"\bportfolio\b|\bpersonal\s*(?:site|website)\b"),
    ("website_url", r"\bwebsite\b|\burl\b|\bweb\s*page\b"),
    ("resume_file", r"\bresume\b|\bcv\b|\bcurriculum"),
    ("cover_letter", r"\bcover\s*letter\b"),
    ("work_authorization", r"\bauthoriz(?:ation|ed)\b|\bsponsorship\b|\bwork\s*(?:permit|visa)\b|\blegally\b"),
    ("salary_expectation", r"\bsalary\b|\bcompensation\b|\bpay\s*(?:range|expectation)\b"),
    ("location", r"\blocation\b|\bcity\b|\bwhere.*(?:you|located)\b"),
    ("how_did_you_hear", r"\bhow\s*did\s*you\s*hear\b|\breferral\s*source\b|\bwhere.*(?:find|learn)\b"),
]

# names of fields that hold a posting's identifier, alone or behind an underscore
ID_FIELD = "(?:^|_)(id|jobid|job_id|postingid|posting_id|requisitionid|requisition_id|reqid|req_id|contestno|externalpath|guid|uuid|slug|token)$"

# lines that are no summary: headings, boilerplate
SUMMARY_HEADING = r"^[A-Z][A-Z\s&'/():-]{3,}$|^#{1,3}\s"
SUMMARY_BOILERPLATE = "(?i)^(equal opportunity|we are an? |disclaimer|eoe|accommodation|diversity|note to|about us$|about the company$)"

# a description's points: a heading, a list, a paragraph, length up to LENGTH_MOST by LENGTH_PART, each sign of page chrome
HEADER_POINTS, LIST_POINTS, PARAGRAPH_POINTS, LENGTH_MOST, LENGTH_PART, NOISE_POINTS = 45, 30, 8, 2400, 12, 140
NOISE_WORDS = ["skip to main content", "open search bar", "saved", "apply now", "similar jobs", "join our talent community", "manage preferences", "accept all", "search", "locations"]

# headings of sections, where a description begins and ends on a page, signs of markup, lines of page chrome
SECTION_HEADINGS = [
    "about the job", "about the role", "about this role", "role overview", "position overview", "job description", "job summary", "responsibilities", "key responsibilities", "what you'll do", "what youll do", "what you will do", "what you'll bring", "what youll bring",
    "what you will bring", "what we're looking for", "what were looking for", "required qualifications", "minimum qualifications", "preferred qualifications", "qualifications", "requirements", "nice to have", "benefits", "compensation", "salary", "industry", "domain",
    "department", "details", "about us", "about the team", "experience", "skills", "soft skills", "work location", "hours", "line of business", "pay details", "who we are", "our total rewards package", "additional information", "colleague development",
    "training & onboarding", "interview process", "accommodation", "language requirement", "work authorization",
]
START_MARKERS = ["job description", "job summary", "about the job", "about the role", "what does a successful", "what you'll do", "what we're looking for", "what you will do"]
END_MARKERS = [
    "similar jobs", "receive similar jobs by email", "create alert", "popular jobs", "top job titles", "top job types", "top companies", "top locations", "jobseekers", "recruiters", "country selection", "back to last search", "show full description",
    'window["az_details"]', "job_desc_modal_details", "var path =", "var lang =", "var frontend =",
]
MARKUP_SIGNS = ["window[", "function(", "googletagmanager", "country selection", "similar jobs", "join our talent community", "manage preferences", "accept all", "top job titles", "top companies"]
CHROME_LINES = [
    "united kingdom", "australia", "österreich", "belgië", "brasil", "canada", "france", "deutschland", "india", "italia", "méxico", "nederland", "new zealand", "polska", "singapore", "south africa", "españa", "schweiz", "united states", "usa",
    "continue", "what?", "where?", "search", "advanced", "sorry, this job is not available in your region", "search for similar jobs in your region", "receive similar jobs by email", "create alert", "show full description", "similar jobs", "popular jobs", "top job titles",
    "top job types", "top companies", "top locations", "jobseekers", "recruiters", "privacy", "terms & conditions", "country selection", "change", "select your country to see jobs specific to your location.", "create email alert", "no thanks, take me to the job",
]
SCRIPT_LINE = r"^(var |window\.|window\[|function\(|new date\(|https://www\.googletagmanager)"
JSON_LINE = '"@type"|itemlistelement|ga4_event_options|query_info|currency_iso|privacy notice'
CALLS_TO_APPLY = r"\b(click here to apply|apply now!?|submit your application today)\b[.!]*"
BARE_HEADINGS = r"\b(What Youll Do|What Youll Bring|Who We Are|Job Summary|Key Responsibilities|Required Qualifications|Preferred Qualifications|Additional Information|Interview Process|Work Authorization)\b(?!\s*:)"
# a label and its value on one line, labels whose value gets a line of its own, the longest such value; what a page's embedded description stands behind, how far, and its shortest length
INLINE_LABEL, INLINE_VALUE_MOST = r"[A-Z][A-Za-z0-9/&+,'’() -]{1,48}", 220
LABEL_OF_TWO_WORDS, LABEL_WORDS = r"[A-Z][a-z]+\s+[A-Z]", ["location", "salary", "compensation", "business"]
EMBEDDED_MARKERS, EMBEDDED_REACH, EMBEDDED_LEAST = ['window["az_details"]', "window['az_details']", '"az_details"'], 60000, 120

# signs of currencies in English; others by their code
CURRENCY_SIGNS = {"USD": "$", "CAD": "CA$", "EUR": "€", "GBP": "£", "AUD": "A$", "NZD": "NZ$"}

# sectors of catalog companies that count
CATALOG_SECTORS = "(finance|bank|insurance|payments|telecom|enterprise|cloud|infra|security|data|health|consulting)"

# company sites: links to postings, links to further pages, words of a page about openings
JOB_LINK = "(job|career|position|opening|opportunit|vacanc|posting|requisition|role)"
PAGING_LINK = r"(next|more|older|page \d+)"
CAREER_PAGE = [r"\bcareers?\b", r"\bopen roles?\b", r"\bopen positions?\b", r"\bjob openings?\b", r"\bjoin (our )?team\b", r"\bwork with us\b", r"\bsearch jobs\b", r"\bview jobs\b", r"\bcurrent openings\b", r"\bopportunities\b"]

# résumés: headings of sections, contacts
RESUME_SECTIONS = {
    "summary": ["summary", "professional summary", "profile", "about", "objective"], "skills": ["skills", "technical skills", "skills and tools"], "experience": ["experience", "work experience", "professional experience", "employment"],
    "education": ["education", "academic background"], "projects": ["projects", "personal projects", "selected projects"],
}
MAIL = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"(?:\+\d{1,3}[\s-]?)?(?:\(?\d{3}\)?[\s-]?)\d{3}[\s-]?\d{4}"
LINKEDIN_URL = r"https?://(?:www\.)?linkedin\.com/[^\s)]+"
GITHUB_URL = r"https?://(?:www\.)?github\.com/[^\s)]+"

# Minutes that a task of a kind may be worked on before it goes back to the queue, and those of other kinds.
LEASE_MINUTES = {"COMPANY_DISCOVERY": 180, "REDISCOVERY": 180, "SOURCE_VALIDATION": 60, "CONNECTOR_POLL": 120, "URL_HEALTH": 45}
LEASE_OTHERS = 120
# The least, the usual and the most minutes between two cycles.
CYCLE_MINUTES = (5, 10, 360)

# words that a search in English leaves out
SEARCH_STOP_WORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those
    am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below
    to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split()
# weights of where a term stands, in tenths
SEARCH_WEIGHTS = {"title": 10, "company": 4, "role_family": 2, "location": 1}

# the published English stemmer (Porter's second): words with a stem of their own, words left as they are after the plurals, beginnings that count as a whole, endings and what becomes of them
STEM_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STEM_KEPT = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEM_BEGINNINGS = ["gener", "commun", "arsen"]
STEM_ENDINGS_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEM_ENDINGS_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEM_ENDINGS_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]
