"""One query per source: payloads as a board would send them, made of the driver's rows, parsed again; the SQL reads the same rows without the detour.

A payload holds the postings of one token, twenty at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postforge.bindings import AS_OF, view
from postforge.plans.queries import query
from postforge.sources import boards, markup

PAGE = 20
_T = "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
POSTED, DUE = _T.format("posted_at"), _T.format("deadline")
TEXT = {"source_name", "source_id", "source_url", "title", "company", "location", "description", "apply_url", "employment_type", "work_mode", "salary_currency", "freshness_mode"}
OUT = ("source_name", "source_id", "source_url", "title", "company", "location", "description", "apply_url", "posted", "due", "employment_type", "work_mode", "salary_min", "salary_max", "salary_currency", "freshness_mode")
TOKEN, NAME = "'acme-labs-' || CAST(id // 20 AS VARCHAR)", "'Acme Labs ' || CAST(id // 20 AS VARCHAR)"


def shown(postings: DataFrame) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return postings.withColumns({"posted": us("posted_at"), "due": us("deadline")}).select(*OUT)


def wanted(prefix: str, where: str = "true", token: str = TOKEN, freshness: str = "FULL_SNAPSHOT", **columns: str) -> str:
    """SQL for shown(): columns that aren't named are null."""
    columns = {"source_name": f"'{prefix}:' || {token}", "freshness_mode": f"'{freshness}'"} | columns
    kind = lambda c: "VARCHAR" if c in TEXT else "BIGINT" if c in ("posted", "due") else "DOUBLE"
    return "SELECT " + ", ".join(f"CAST({columns.get(c, 'NULL')} AS {kind(c)}) AS {c}" for c in OUT) + f" FROM canonical WHERE {where}"


def landed(spark: SparkSession, d: str, item: str, wrap: str = "jobs", token: str = "concat('acme-labs-', CAST(id div 20 AS STRING))") -> DataFrame:
    """token, payload, fetched_at."""
    g = view(spark, d, "canonical").selectExpr(f"{token} AS token", f"{item} AS j").groupBy("token").agg(F.collect_list("j").alias("jobs"))
    return g.selectExpr("token", f"to_json({wrap}) AS payload", f"TIMESTAMP_NTZ'{AS_OF}' AS fetched_at")


def board(name: str, want: str, item: str, wrap: str = "jobs", token: str | None = None, around: str = "payload"):
    """Registers source_<name>."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = landed(spark, d, item, wrap, token) if token else landed(spark, d, item, wrap)
        return shown(boards.parse(rows.withColumn("payload", F.expr(around)), name))

    run.__name__ = f"source_{name}"
    query(want, "canonical")(run)


P, D, URL = "epoch_us(posted_at)", "epoch_us(deadline)", "nullif(apply_url, '')"
CODE = "CASE id % 5 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} WHEN 3 THEN {} ELSE {} END"
KIND = "CASE id % 5 WHEN 0 THEN 'FULL_TIME' WHEN 1 THEN 'CONTRACT' WHEN 2 THEN 'INTERNSHIP' WHEN 3 THEN 'PART_TIME' END"
MODE = "CASE WHEN contains(lower({0}), 'remote') THEN 'REMOTE' WHEN contains(lower({0}), 'hybrid') THEN 'HYBRID' END"
PAY = {"salary_min": "salary_min", "salary_max": "salary_max"}


def codes(*words: str) -> str:
    return CODE.format(*[f"'{w}'" for w in words])


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


NONE = "CAST(NULL AS STRING)"
AWAY = "CASE id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Worldwide' WHEN 2 THEN 'North America only' WHEN 3 THEN 'USA Only' WHEN 4 THEN 'Canada' ELSE 'Poland' END"
AWAY_SQL = "CASE id % 6 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Remote (Worldwide)' WHEN 2 THEN 'Remote (North America)' WHEN 3 THEN 'Remote (US Only)' WHEN 4 THEN 'Remote (Canada)' ELSE 'Remote (Poland)' END"

board(
    "greenhouse",
    wanted("Greenhouse", source_id="id", source_url="apply_url", title="title", company="company", location="CASE WHEN id % 5 = 0 THEN 'Unknown' ELSE location END", description="description", apply_url="apply_url", posted=P),
    struct(id="id", absolute_url="apply_url", title="title", company_name="company", location=struct(name="IF(id % 5 = 0, NULL, location)"), content="description", first_published=POSTED),
    "named_struct('jobs', jobs)",
)

_HOSTED, _APPLY = "CASE WHEN id % 4 <> 0 THEN 'https://jobs.lever.co/x/' || CAST(id AS VARCHAR) END", "CASE WHEN id % 3 <> 0 THEN 'https://jobs.lever.co/x/' || CAST(id AS VARCHAR) || '/apply' END"
board(
    "lever",
    wanted(
        "Lever", source_id="'lv-' || CAST(id AS VARCHAR)", source_url=f"coalesce({_HOSTED}, {_APPLY})", title="title", company=NAME, location="CASE WHEN id % 2 = 0 THEN location || ', Berlin' ELSE location END", description="description || CASE WHEN id % 2 = 0 THEN chr(10) || chr(10) || 'We ship.' ELSE '' END",
        apply_url=f"coalesce({_APPLY}, {_HOSTED}, '')", posted=P, employment_type=KIND, work_mode="nullif(work_mode, 'UNKNOWN')", salary_currency="CASE WHEN salary_min IS NOT NULL THEN 'CAD' END", **PAY,
    ),
    struct(
        id="concat('lv-', id)", text="title", descriptionPlain="description", openingPlain="IF(id % 2 = 0, ' We ship. ', '')", applyUrl="IF(id % 3 = 0, NULL, concat('https://jobs.lever.co/x/', id, '/apply'))", hostedUrl="IF(id % 4 = 0, NULL, concat('https://jobs.lever.co/x/', id))", createdAt="unix_millis(CAST(posted_at AS TIMESTAMP))",
        categories=struct(commitment=codes("Full-time", "Contract", "Internship", "Part-time", "Volunteer"), location="location", allLocations="IF(id % 2 = 0, array(location, ' Berlin ', 'Berlin', location), array())"), workplaceType="lower(work_mode)", country="'CA'",
        salaryRange=struct(min="salary_min", max="salary_max", currency="IF(salary_min IS NULL, NULL, 'CAD')"),
    ),
)

_SITE = "CASE WHEN id % 5 = 0 THEN 'https://' || " + TOKEN + " || '.recruitee.com/o/role-' || CAST(id AS VARCHAR) ELSE 'https://x.example/' || CAST(id AS VARCHAR) END"
board(
    "recruitee",
    wanted(
        "Recruitee", "id % 6 <> 0", source_id="CASE WHEN id % 3 = 0 THEN CAST(id AS VARCHAR) ELSE 'g' || CAST(id AS VARCHAR) END", source_url=_SITE, title="title", company=f"CASE WHEN id % 4 = 0 THEN {NAME} ELSE company END", location="CASE WHEN id % 7 = 0 THEN 'Remote EU | Delft, ZH, NL' ELSE location END",
        description="'<h2>Role</h2>' || chr(10) || description || CASE WHEN id % 2 = 0 THEN chr(10) || chr(10) || '<h2>Requirements</h2>' || chr(10) || 'Be kind' ELSE '' END", apply_url=_SITE, posted=P, due=D, employment_type=KIND, work_mode="CASE WHEN work_mode IN ('HYBRID', 'REMOTE', 'ONSITE') THEN work_mode END",
        salary_currency="'CAD'", **PAY,
    ),
    struct(
        id="id", guid="IF(id % 3 = 0, NULL, concat('g', id))", slug="concat('role-', id)", title="title", company_name="IF(id % 4 = 0, ' ', company)", description="description", requirements="IF(id % 2 = 0, 'Be kind', NULL)", careers_url="IF(id % 5 = 0, NULL, concat('https://x.example/', id))", city="'Delft'", country="'NL'", location="location",
        remote="work_mode = 'REMOTE'", hybrid="work_mode = 'HYBRID'", on_site="work_mode = 'ONSITE'", published_at=POSTED, close_at=DUE, employment_type_code=codes("fulltime_permanent", "contract", "internship", "parttime", "other"), status="CASE id % 6 WHEN 0 THEN 'draft' WHEN 1 THEN NULL ELSE 'published' END",
        salary=struct(min="CAST(salary_min AS STRING)", max="CAST(salary_max AS STRING)", currency="' CAD '"),
        locations="IF(id % 7 = 0, array(named_struct('name', ' Remote EU ', 'city', 'X', 'state', 'Y', 'country', 'Z'), named_struct('name', 'HQ', 'city', 'Delft', 'state', 'ZH', 'country', 'NL'), named_struct('name', 'Second', 'city', 'Delft', 'state', 'ZH', 'country', 'NL')), NULL)",
    ),
    "named_struct('offers', jobs)",
)

board(
    "rippling",
    wanted(
        "Rippling", source_id="'u' || CAST(id AS VARCHAR)", source_url="'https://ats.rippling.com/a/jobs/u' || CAST(id AS VARCHAR)", apply_url="'https://ats.rippling.com/a/jobs/u' || CAST(id AS VARCHAR)", title="title", company=NAME, location="CASE id % 3 WHEN 0 THEN 'Canada' WHEN 1 THEN 'Austin, TX' ELSE location END",
        work_mode="CASE id % 3 WHEN 0 THEN 'REMOTE' WHEN 1 THEN 'HYBRID' ELSE " + MODE.format("location") + " END", description="CASE WHEN id % 3 = 0 THEN '' ELSE 'Department: Ops' || chr(10) END || 'Work location: ' || CASE id % 3 WHEN 0 THEN 'Remote (Canada)' WHEN 1 THEN 'Hybrid (Austin, TX)' ELSE location END",
    ),
    struct(uuid="concat('u', id)", name="title", url="concat('https://ats.rippling.com/a/jobs/u', id)", department=struct(label="IF(id % 3 = 0, '', 'Ops')"), workLocation=struct(label="CASE id % 3 WHEN 0 THEN 'Remote (Canada)' WHEN 1 THEN 'Hybrid (Austin, TX)' ELSE location END")),
)

board(
    "smartrecruiters",
    wanted(
        "SmartRecruiters", source_id="'s' || CAST(id AS VARCHAR)", source_url="'https://jobs.smartrecruiters.com/A/' || CAST(id AS VARCHAR)", title="title", company=f"CASE WHEN id % 4 = 0 THEN {NAME} ELSE company END", location="CASE id % 3 WHEN 0 THEN location WHEN 1 THEN 'Lyon, FR' ELSE 'Unknown' END",
        description="CASE WHEN id % 2 = 0 THEN 'Ops · ' ELSE '' END || 'Finance · Senior'", apply_url="'https://jobs.smartrecruiters.com/A/' || CAST(id AS VARCHAR)", posted=P, employment_type="CASE id % 5 WHEN 4 THEN 'FULL_TIME' ELSE " + KIND + " END", work_mode="CASE WHEN work_mode IN ('HYBRID', 'REMOTE') THEN work_mode END",
    ),
    struct(
        id="concat('s', id)", name="title", releasedDate=POSTED, postingUrl="concat('https://jobs.smartrecruiters.com/A/', id)", location=struct(city="IF(id % 3 = 1, 'Lyon', NULL)", country="IF(id % 3 = 1, 'FR', NULL)", remote="work_mode = 'REMOTE'", hybrid="work_mode = 'HYBRID'", fullLocation="IF(id % 3 = 0, location, '')"),
        company=struct(name="IF(id % 4 = 0, NULL, company)"), function=struct(label="IF(id % 2 = 0, 'Ops', ' ')"), department=struct(label="'Finance'"), experienceLevel=struct(label="'Senior'"), typeOfEmployment=struct(label=codes("Full-time", "Contract", "Intern", "Part-time", "Permanent")),
    ),
    "named_struct('content', jobs)",
)

_CODE_ID = "CASE WHEN id % 3 = 0 THEN 'C' || CAST(id AS VARCHAR) ELSE 'S' || CAST(id AS VARCHAR) END"
_WORK = "CASE WHEN id % 4 = 0 THEN 'https://apply.workable.com/' || " + TOKEN + " || '/j/' || " + _CODE_ID + " || '/' ELSE 'https://w.example/' || CAST(id AS VARCHAR) END"
board(
    "workable",
    wanted(
        "Workable", "id % 11 <> 0", source_id=_CODE_ID, source_url=_WORK, title="title", company="'Acme Inc'", location="CASE id % 3 WHEN 0 THEN location WHEN 1 THEN 'Lyon, FR' ELSE CASE WHEN work_mode = 'REMOTE' THEN 'Remote' ELSE 'Unknown' END END", description="'Short.' || chr(10) || chr(10) || description || chr(10) || chr(10) || 'About us.'", apply_url=_WORK,
        posted=P, employment_type=KIND, work_mode="CASE WHEN work_mode = 'REMOTE' THEN 'REMOTE' WHEN id % 3 = 0 AND contains(lower(location), 'remote') THEN 'REMOTE' WHEN work_mode = 'HYBRID' OR (id % 3 = 0 AND contains(lower(location), 'hybrid')) THEN 'HYBRID' WHEN work_mode = 'ONSITE' THEN 'ONSITE' WHEN work_mode = 'FLEXIBLE' THEN 'FLEXIBLE' END",
    ),
    struct(
        title="IF(id % 11 = 0, ' ', title)", shortcode="IF(id % 3 = 0, NULL, concat('S', id))", code="concat('C', id)", url="IF(id % 4 = 0, NULL, concat('https://w.example/', id))", employment_type=codes("Full-time", "Contract", "Intern", "Part-time", "Other"), work_place="lower(work_mode)", remote="work_mode = 'REMOTE'", created_at=POSTED, description="description", short_description="'Short.'",
        location=struct(city="IF(id % 3 = 1, 'Lyon', NULL)", country="IF(id % 3 = 1, 'FR', NULL)", location_str="IF(id % 3 = 0, location, '')"),
    ),
    "named_struct('name', ' Acme Inc ', 'description', 'About us.', 'jobs', jobs)",
)

board(
    "jobicy",
    wanted(
        "Jobicy", "id % 9 <> 0", source_id="'jobicy:' || CAST(id AS VARCHAR)", source_url="'https://jobicy.com/' || CAST(id AS VARCHAR)", title="title", company="CASE WHEN id % 4 = 0 THEN 'Unknown Company' ELSE company END", location=AWAY_SQL, description="CASE WHEN id % 2 = 0 THEN 'In short' ELSE description END", apply_url="'https://jobicy.com/' || CAST(id AS VARCHAR)", posted=P,
        employment_type="CASE id % 5 WHEN 1 THEN 'CONTRACT' WHEN 2 THEN 'INTERNSHIP' WHEN 3 THEN 'PART_TIME' END", work_mode="'REMOTE'", salary_currency="CASE WHEN id % 3 = 0 THEN 'EUR' WHEN salary_min IS NOT NULL THEN 'USD' END", **PAY,
    ),
    struct(
        id="id", url="concat('https://jobicy.com/', id)", jobTitle="IF(id % 9 = 0, '', concat(' ', title))", companyName="IF(id % 4 = 0, '', company)", jobType=f"array({codes('full-time', 'contract', 'internship', 'part-time', 'other')})", jobGeo=AWAY, jobExcerpt="'In short'", jobDescription="IF(id % 2 = 0, NULL, description)", pubDate=POSTED,
        annualSalaryMin="CAST(salary_min AS STRING)", annualSalaryMax="CAST(salary_max AS STRING)", salaryCurrency="IF(id % 3 = 0, 'EUR', NULL)",
    ),
    "named_struct('jobs', concat(jobs, jobs))",
)

_OK_URL = "CASE WHEN id % 4 = 0 THEN 'https://remoteok.com/remote-jobs/r' || CAST(id AS VARCHAR) ELSE 'https://ok.example/' || CAST(id AS VARCHAR) END"
_SAID = "title || ' ' || left(description, 500)"
board(
    "remoteok",
    wanted(
        "RemoteOK", "id % 9 <> 0", source_id="'remoteok:' || CAST(id AS VARCHAR)", source_url=_OK_URL, title="title", company="company", location=AWAY_SQL, description="description", apply_url=_OK_URL, posted=P, work_mode="'REMOTE'", salary_currency="CASE WHEN salary_min IS NOT NULL THEN 'USD' END",
        employment_type=f"CASE WHEN regexp_matches({_SAID}, '(?i)\\bcontract\\b') THEN 'CONTRACT' WHEN regexp_matches({_SAID}, '(?i)\\bpart[- ]?time\\b') THEN 'PART_TIME' WHEN regexp_matches({_SAID}, '(?i)\\bintern(ship)?\\b') THEN 'INTERNSHIP' END", **PAY,
    ),
    struct(slug="concat('r', id)", id="CAST(id AS STRING)", epoch="unix_seconds(CAST(posted_at AS TIMESTAMP))", date=f"IF(id % 2 = 0, NULL, {POSTED})", company="company", position="IF(id % 9 = 0, '', title)", description="description", location=AWAY, salary_min="coalesce(salary_min, 0)", salary_max="coalesce(salary_max, 0)", url="IF(id % 4 = 0, NULL, concat('https://ok.example/', id))"),
    "concat(array(named_struct('slug', NULL, 'id', NULL, 'epoch', NULL, 'date', NULL, 'company', NULL, 'position', NULL, 'description', 'legal notice', 'location', NULL, 'salary_min', NULL, 'salary_max', NULL, 'url', NULL)), jobs)",
)

board(
    "remotive",
    wanted(
        "Remotive", "id % 9 <> 0", source_id="'remotive:' || CAST(id AS VARCHAR)", source_url="'https://remotive.com/' || CAST(id AS VARCHAR)", title="title", company="company", location=AWAY_SQL, description="description", apply_url="'https://remotive.com/' || CAST(id AS VARCHAR)", posted=P, work_mode="'REMOTE'",
        employment_type="CASE id % 5 WHEN 4 THEN 'CONTRACT' ELSE " + KIND + " END", salary_min="CASE id % 4 WHEN 0 THEN 50000 WHEN 1 THEN 60000 WHEN 2 THEN 45.5 END", salary_max="CASE id % 4 WHEN 0 THEN 70000 WHEN 1 THEN 60000 WHEN 2 THEN 45.5 END", salary_currency="CASE id % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' END",
    ),
    struct(id="id", url="concat('https://remotive.com/', id)", title="title", company_name="IF(id % 9 = 0, '', company)", job_type=codes("full_time", "contract", "internship", "part_time", "freelance"), publication_date=POSTED, candidate_required_location=AWAY, salary="CASE id % 4 WHEN 0 THEN '$50k - $70 K' WHEN 1 THEN '€60000' WHEN 2 THEN '45.5 an hour' ELSE 'competitive' END", description="description"),
    "named_struct('jobs', jobs)",
)

board(
    "themuse",
    wanted(
        "TheMuse", "id % 9 <> 0", source_id="'themuse:' || CAST(id AS VARCHAR)", source_url="CASE WHEN id % 4 <> 0 THEN 'https://muse.example/' || CAST(id AS VARCHAR) END", title="title", company="CASE WHEN id % 5 = 0 THEN 'Unknown Company' ELSE company END", description="description", apply_url="CASE WHEN id % 4 <> 0 THEN 'https://muse.example/' || CAST(id AS VARCHAR) ELSE '' END", posted=P,
        location="CASE id % 4 WHEN 0 THEN 'Lyon; Paris; Nice' WHEN 1 THEN 'Remote' WHEN 2 THEN 'Hybrid/Remote (Lyon)' ELSE 'Unknown' END", work_mode="CASE id % 4 WHEN 1 THEN 'REMOTE' WHEN 2 THEN 'HYBRID' ELSE 'ONSITE' END", employment_type="CASE id % 5 WHEN 0 THEN NULL WHEN 4 THEN 'CONTRACT' ELSE " + KIND + " END",
    ),
    struct(
        id="id", name="IF(id % 9 = 0, NULL, title)", type=codes("external", "Contract", "internship", "part time", "freelance"), publication_date=POSTED, contents="description", refs=struct(landing_page="IF(id % 4 = 0, NULL, concat('https://muse.example/', id))"), company=struct(name="IF(id % 5 = 0, NULL, company)"),
        locations="CASE id % 4 WHEN 0 THEN array(named_struct('name', 'Lyon'), named_struct('name', 'Paris'), named_struct('name', 'Nice'), named_struct('name', 'Lille')) WHEN 1 THEN array(named_struct('name', 'Flexible / Remote')) WHEN 2 THEN array(named_struct('name', 'Lyon'), named_struct('name', 'Remote')) ELSE array() END",
    ),
    "named_struct('results', concat(jobs, jobs))",
)

board(
    "usajobs",
    wanted(
        "USAJobs", "id % 9 <> 0", source_id="'usajobs:P' || CAST(id AS VARCHAR)", source_url="CASE WHEN id % 4 <> 0 THEN 'https://usa.example/' || CAST(id AS VARCHAR) END", title="title", company="CASE id % 3 WHEN 0 THEN 'Navy (Defense)' WHEN 1 THEN 'Treasury' ELSE 'US Federal Government' END", location="CASE id % 3 WHEN 0 THEN 'Reno, NV; Ely, NV; Base (+1 more)' WHEN 1 THEN 'Base' ELSE 'United States' END",
        description="CASE WHEN id % 2 = 0 THEN description || chr(10) || chr(10) || 'Qualifications:' || chr(10) || 'Skill' || chr(10) || chr(10) || 'Major Duties:' || chr(10) || '• One' || chr(10) || '• Two' ELSE 'See full posting for details.' END", apply_url="CASE WHEN id % 4 <> 0 THEN 'https://usa.example/' || CAST(id AS VARCHAR) ELSE 'https://www.usajobs.gov/job/P' || CAST(id AS VARCHAR) END",
        posted=P, due=D, employment_type="CASE id % 4 WHEN 0 THEN 'PART_TIME' WHEN 1 THEN 'CONTRACT' WHEN 2 THEN 'CONTRACT' ELSE 'INTERNSHIP' END", work_mode="CASE WHEN id % 2 = 0 THEN 'HYBRID' END", salary_currency="CASE WHEN salary_min IS NOT NULL THEN 'USD' END", **PAY,
    ),
    struct(MatchedObjectDescriptor=struct(
        PositionID="IF(id % 9 = 0, '', concat('P', id))", PositionTitle="title", PositionURI="IF(id % 4 = 0, NULL, concat('https://usa.example/', id))", OrganizationName="CASE id % 3 WHEN 0 THEN 'Navy' WHEN 1 THEN 'Treasury' END", DepartmentName="CASE id % 3 WHEN 0 THEN 'Defense' WHEN 1 THEN 'Treasury' END",
        PositionLocation="CASE id % 3 WHEN 0 THEN array(named_struct('LocationName', 'a', 'CityName', 'Reno', 'CountrySubDivisionCode', 'NV'), named_struct('LocationName', 'b', 'CityName', 'Ely', 'CountrySubDivisionCode', 'NV'), named_struct('LocationName', 'Base', 'CityName', '', 'CountrySubDivisionCode', ''), named_struct('LocationName', 'c', 'CityName', 'd', 'CountrySubDivisionCode', 'e')) WHEN 1 THEN array(named_struct('LocationName', 'Base', 'CityName', '', 'CountrySubDivisionCode', '')) ELSE array() END",
        PositionSchedule="array(named_struct('Name', CASE id % 4 WHEN 0 THEN 'Part-time' WHEN 1 THEN 'Intermittent' ELSE 'Full-time' END))", PositionOfferingType="array(named_struct('Name', IF(id % 4 = 2, 'Term', 'Internship')))", PositionRemuneration="array(named_struct('MinimumRange', CAST(salary_min AS STRING), 'MaximumRange', CAST(salary_max AS STRING)))",
        QualificationSummary="IF(id % 2 = 0, 'Skill', NULL)", PublicationStartDate=POSTED, ApplicationCloseDate=DUE, UserArea=struct(Details=struct(JobSummary="IF(id % 2 = 0, description, NULL)", MajorDuties="IF(id % 2 = 0, array('One', 'Two'), array())", TeleworkEligible="id % 2 = 0")),
    )),
    "named_struct('SearchResult', named_struct('SearchResultItems', concat(jobs, jobs)))",
)

board(
    "adzuna",
    wanted(
        "Adzuna", "id % 9 <> 0 AND id % 10 <> 0", token="CASE WHEN (id // 20) % 2 = 0 THEN 'ca' ELSE 'us' END || CAST(id // 20 AS VARCHAR)", source_id="'adzuna:' || CASE WHEN (id // 20) % 2 = 0 THEN 'ca' ELSE 'us' END || CAST(id // 20 AS VARCHAR) || ':' || CAST(id AS VARCHAR)", source_url="'https://ad.example/' || CAST(id AS VARCHAR)", title="title",
        company="CASE WHEN id % 4 = 0 THEN 'Unknown Company' ELSE company END", location="CASE WHEN id % 5 = 0 THEN 'Unknown' ELSE location END", description="description", apply_url="'https://ad.example/' || CAST(id AS VARCHAR)", posted=P, employment_type="CASE id % 3 WHEN 0 THEN 'CONTRACT' WHEN 1 THEN 'PART_TIME' ELSE 'FULL_TIME' END",
        work_mode="CASE WHEN contains(lower(title || ' ' || description || ' ' || CASE WHEN id % 5 = 0 THEN '' ELSE location END), 'hybrid') THEN 'HYBRID' WHEN contains(lower(title || ' ' || description || ' ' || CASE WHEN id % 5 = 0 THEN '' ELSE location END), 'remote') THEN 'REMOTE' END",
        salary_min="CASE WHEN id % 2 = 0 THEN salary_min END", salary_max="CASE WHEN id % 2 = 0 THEN salary_max END", salary_currency="CASE WHEN salary_min IS NOT NULL THEN 'USD' END",
    ),
    struct(
        id="IF(id % 9 = 0, '', CAST(id AS STRING))", title="title", description="description", company=struct(display_name="CASE WHEN id % 10 = 0 THEN 'TEKsystems' WHEN id % 4 = 0 THEN NULL ELSE company END"), location=struct(display_name="IF(id % 5 = 0, NULL, location)"), redirect_url="concat('https://ad.example/', id)", created=POSTED, salary_min="salary_min", salary_max="salary_max",
        salary_is_predicted="IF(id % 2 = 0, '0', '1')", contract_time="IF(id % 3 = 1, 'part_time', 'full_time')", contract_type="IF(id % 3 = 0, 'contract', 'permanent')",
    ),
    "named_struct('results', jobs)",
    token="concat(IF((id div 20) % 2 = 0, 'ca', 'us'), CAST(id div 20 AS STRING))",
)

board(
    "himalayas",
    wanted(
        "Himalayas", "id % 9 <> 0", source_id="'himalayas:' || CASE WHEN id % 2 = 0 THEN 'g' ELSE 'i' END || CAST(id AS VARCHAR)", source_url="'https://h.example/' || CAST(id AS VARCHAR)", title="title", company="CASE WHEN id % 4 = 0 THEN 'Unknown Company' ELSE company END", location="CASE WHEN id % 3 = 0 THEN 'Remote (Canada, Peru)' ELSE 'Remote' END", description="description",
        apply_url="'https://h.example/' || CAST(id AS VARCHAR)", posted=P, due=D, employment_type=KIND, work_mode="'REMOTE'", salary_currency="CASE WHEN salary_min IS NOT NULL THEN 'USD' END", **PAY,
    ),
    struct(
        id="concat('i', id)", guid="IF(id % 2 = 0, concat('g', id), NULL)", title="IF(id % 9 = 0, '', title)", companyName="IF(id % 4 = 0, NULL, company)", employmentType=codes("Full Time", "Contractor", "Intern", "Part Time", "Other"), description="description", applicationLink="concat('https://h.example/', id)", pubDate=POSTED, expiryDate=DUE, minSalary="salary_min", maxSalary="salary_max",
        locationRestrictions="IF(id % 3 = 0, array('Canada', 'Peru'), array())",
    ),
    "named_struct('jobs', concat(jobs, jobs))",
)

_ASHBY = f"'https://jobs.ashbyhq.com/' || {TOKEN} || '/a' || CAST(id AS VARCHAR)"
board(
    "ashby",
    wanted(
        "Ashby", "id % 8 <> 0", source_id="'a' || CAST(id AS VARCHAR)", source_url=_ASHBY, apply_url=_ASHBY, title="title", company=NAME, location="CASE WHEN id % 2 = 0 THEN location || ', Berlin' ELSE location END", description="CASE WHEN id % 3 = 0 THEN '' ELSE 'Team: Core' || chr(10) END || 'Department: R&D'", posted=P, due=D, employment_type="CASE id % 5 WHEN 4 THEN 'CONTRACT' ELSE " + KIND + " END",
        work_mode="nullif(work_mode, 'UNKNOWN')",
    ),
    struct(
        id="concat('a', id)", title="title", publishedDate=f"IF(id % 2 = 0, {POSTED}, NULL)", updatedAt=POSTED, applicationDeadline=DUE, locationName="location", workplaceType="initcap(work_mode)", employmentType=codes("FullTime", "Contract", "Intern", "PartTime", "Temporary"), isListed="CASE WHEN id % 8 = 0 THEN false WHEN id % 8 = 1 THEN NULL ELSE true END", departmentName="'R&D'",
        teamName="IF(id % 3 = 0, '', 'Core')", secondaryLocations="IF(id % 2 = 0, array(named_struct('locationName', ' Berlin'), named_struct('locationName', location)), array())",
    ),
    "named_struct('jobBoard', named_struct('jobPostings', jobs))",
    around="concat('<html><script>window.__appData = ', payload, ';\n</script><body>x</body></html>')",
)

_WD = "'https://acme.wd5.myworkdayjobs.com/Ext' || CAST(id // 20 AS VARCHAR) || '/job/x_R-' || CAST(id AS VARCHAR)"
board(
    "workday",
    wanted(
        "Workday", "id % 9 <> 0", token="'acme.wd5.myworkdayjobs.com/acme-labs/Ext' || CAST(id // 20 AS VARCHAR)", source_id="CASE WHEN id % 4 = 0 THEN '/job/x_R-' || CAST(id AS VARCHAR) ELSE 'R-' || CAST(id AS VARCHAR) END", source_url=_WD, apply_url=_WD, title="title", company="'Acme Labs'", location="CASE WHEN id % 5 = 0 THEN 'Unknown' ELSE location END",
        description="CASE WHEN id % 4 = 0 THEN 'Team' ELSE 'Team' || chr(10) || 'R-' || CAST(id AS VARCHAR) END", work_mode="CASE WHEN work_mode IN ('REMOTE', 'HYBRID', 'ONSITE', 'FLEXIBLE') THEN work_mode END", posted=f"CASE id % 4 WHEN 0 THEN epoch_us(TIMESTAMP '{AS_OF}') WHEN 1 THEN epoch_us(TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) WHEN 2 THEN epoch_us(TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) END",
    ),
    struct(title="title", externalPath="IF(id % 9 = 0, '', concat('/job/x_R-', id))", locationsText="IF(id % 5 = 0, NULL, location)", postedOn="CASE id % 4 WHEN 0 THEN 'Posted Today' WHEN 1 THEN 'Posted Yesterday' WHEN 2 THEN 'Posted 30+ Days Ago' ELSE 'Posted' END", remoteType="lower(work_mode)", bulletFields="IF(id % 4 = 0, array('Team'), array('Team', concat('R-', id)))"),
    "named_struct('jobPostings', jobs)",
    token="concat('acme.wd5.myworkdayjobs.com/acme-labs/Ext', CAST(id div 20 AS STRING))",
)

_TALEO = "'https://acme-labs.taleo.net/careersection/' || CAST(id // 20 AS VARCHAR) || '/{}.ftl?job=K' || CAST(id AS VARCHAR) || '&lang=en'"
board(
    "taleo",
    wanted(
        "Taleo", token="'acme-labs/' || CAST(id // 20 AS VARCHAR)", source_id="'taleo:acme-labs:K' || CAST(id AS VARCHAR)", source_url=_TALEO.format("jobdetail"), apply_url=_TALEO.format("jobapply"), title="CASE WHEN id % 9 = 0 THEN 'Untitled Position' ELSE title END", company="'Acme Labs'", location="CASE WHEN id % 5 = 0 THEN 'Not specified' ELSE location END",
        description="'Do & learn' || CASE WHEN id % 2 = 0 THEN chr(10) || chr(10) || 'Skill' || chr(10) || 'More' ELSE '' END", posted=P, due=D,
    ),
    struct(contestNo="concat('K', id)", title="IF(id % 9 = 0, ' ', title)", location="IF(id % 5 = 0, NULL, location)", postingDate=f"IF(id % 2 = 0, {POSTED}, NULL)", openingDate=POSTED, closingDate=DUE, description="'<p>Do &amp; learn</p>'", qualifications="IF(id % 2 = 0, '<b>Skill</b><br/>More', '')"),
    "named_struct('requisitionList', jobs, 'total', 20)",
    token="concat('acme-labs/', CAST(id div 20 AS STRING))",
)


# --- boards that answer with pages -----------------------------------------------------------------------------------

_ROW = "concat('<tr class=\"data-row\"><td><a href=\"/job/x-', id, '/\" class=\"jobTitle-link\">', title, ' &amp; more</a></td><td><span class=\"jobLocation\">hidden</span><span class=\"jobLocation\"> ', location, ' </span></td><td><span class=\"jobDate\">', date_format(posted_at, 'MMM d, yyyy'), '</span></td></tr>')"
_DETAIL = "concat('<html><head><title>t</title></head><meta itemprop=\"addressLocality\" content=\"Bonn\"><meta itemprop=\"addressCountry\" content=\"DE\"><meta itemprop=\"hiringOrganization\" content=\"', company, '\"><span itemprop=\"title\" data-x>', title, '</span><a class=\"btn apply\" href=\"/talentcommunity/apply/', id, '/\">Apply</a><span class=\"jobdescription\"><p>Join <span>our <span>best</span></span> team.</p>', description, '</span><span>footer</span></html>')"
_PLAIN = "'Join our best team. ' || trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(description, '<br\\s*/?>|</p>|</li>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))"


@query(f"""+ c AS (SELECT *, id % 3 <> 0 AS known, {_PLAIN} AS said FROM canonical),
x AS (SELECT id, 'https://jobs.acme-labs.com/job/x-' || CAST(id AS VARCHAR) || '/' AS url, known, CASE WHEN known THEN title ELSE title || ' & more' END AS title, CASE WHEN known THEN company ELSE 'Acme Labs' END AS company, CASE WHEN known THEN 'Bonn, DE' ELSE location END AS location,
  CASE WHEN known THEN said ELSE title || ' & more at Acme Labs. ' || location END AS description, epoch_us(date_trunc('day', posted_at)) AS posted FROM c), y AS (SELECT *, lower(location || ' ' || description) AS t, lower(title || ' ' || description) AS u FROM x)
SELECT 'SuccessFactors:jobs.acme-labs.com' AS source_name, url AS source_id, url AS source_url, title, company, location, description, CASE WHEN known THEN 'https://jobs.acme-labs.com/talentcommunity/apply/' || CAST(id AS VARCHAR) || '/' ELSE url END AS apply_url, posted, CAST(NULL AS BIGINT) AS due,
  CASE WHEN NOT known THEN NULL WHEN contains(u, 'intern') OR contains(u, 'co-op') THEN 'INTERNSHIP' WHEN contains(u, 'contract') OR contains(u, 'temporary') OR contains(u, 'fixed-term') THEN 'CONTRACT' WHEN contains(u, 'part time') OR contains(u, 'part-time') THEN 'PART_TIME' END AS employment_type,
  CASE WHEN contains(t, 'hybrid') THEN 'HYBRID' WHEN contains(t, 'remote') OR contains(t, 'virtual') OR contains(t, 'work from home') THEN 'REMOTE' WHEN contains(t, 'flexible') THEN 'FLEXIBLE' WHEN contains(t, 'on-site') OR contains(t, 'onsite') THEN 'ONSITE' END AS work_mode,
  CAST(NULL AS DOUBLE) AS salary_min, CAST(NULL AS DOUBLE) AS salary_max, CAST(NULL AS VARCHAR) AS salary_currency, 'FULL_SNAPSHOT' AS freshness_mode FROM y""", "canonical")  # fmt: skip
def source_successfactors(spark, d):
    c = view(spark, d, "canonical")
    lists = c.selectExpr("id div 20 AS g", f"{_ROW} AS row").groupBy("g").agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list("row"), "\n"), F.lit('<tr class="data-row">no link</tr></table>')).alias("html")).select(F.lit("jobs.acme-labs.com").alias("token"), "html", F.lit(AS_OF).cast("timestamp_ntz").alias("fetched_at"))
    details = c.where("id % 3 <> 0").selectExpr("concat('https://jobs.acme-labs.com/job/x-', id, '/') AS url", f"{_DETAIL} AS html")
    return shown(markup.successfactors(lists, details))


_ICROW = "concat('<li><a class=\"iCIMS_Anchor\" href=\"https://careers-acme-labs.icims.com/jobs/', id, '/role-', id, '/job?in_iframe=1\"><h3> ', title, '</h3></a><span class=\"field-label\">Job Locations</span> <span>', location, '</span><span>Position Type</span> <span>', CASE id % 5 WHEN 0 THEN 'Full-Time' WHEN 1 THEN 'Contract' WHEN 2 THEN 'Intern' WHEN 3 THEN 'Part-Time' ELSE 'x' END, '</span><span>Remote</span> <span>', IF(id % 4 = 0, 'Yes', 'No'), '</span>', repeat('<!-- filler -->', 60), '</li>')"
_ICLD = "concat('<script type=\"application/ld+json\">', to_json(named_struct('@type', 'JobPosting', 'title', title, 'description', '<p>Ship &amp; sell</p>', 'datePosted', date_format(posted_at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), 'hiringOrganization', named_struct('name', company), 'jobLocationType', IF(id % 5 = 0, 'TELECOMMUTE', NULL), 'employmentType', array('FULL_TIME'), 'jobLocation', array(named_struct('address', named_struct('addressLocality', 'Bonn', 'addressCountry', 'DE')), named_struct('address', named_struct('addressLocality', 'Graz', 'addressCountry', 'AT'))), 'baseSalary', named_struct('currency', 'EUR', 'value', named_struct('minValue', IF(id % 2 = 0, 30.5D, 40000D), 'maxValue', IF(id % 2 = 0, 40D, 50000D), 'unitText', IF(id % 2 = 0, 'HOUR', 'YEAR'))))), '</script>')"


@query("""+ c AS (SELECT *, id % 3 = 1 AS ld, id % 3 = 2 AS page FROM canonical WHERE id % 3 > 0),
x AS (SELECT *, 'https://careers-acme-labs.icims.com/jobs/' || CAST(id AS VARCHAR) || '/role-' || CAST(id AS VARCHAR) || '/job' AS url, CASE WHEN ld THEN CASE WHEN id % 5 = 0 THEN 'Remote – ' ELSE '' END || 'Bonn, DE; Graz, AT' ELSE location END AS place FROM c)
SELECT 'iCIMS:careers-acme-labs' AS source_name, CAST(id AS VARCHAR) AS source_id, url AS source_url, title, CASE WHEN ld THEN company ELSE 'Acme Labs' END AS company, place AS location, CASE WHEN ld THEN 'Ship & sell' WHEN page THEN 'Read' || chr(10) || 'this' ELSE '' END AS description, url || '?mode=apply&apply=yes' AS apply_url,
  CASE WHEN ld THEN epoch_us(posted_at) END AS posted, CAST(NULL AS BIGINT) AS due, CASE WHEN ld THEN 'FULL_TIME' ELSE CASE id % 5 WHEN 0 THEN 'FULL_TIME' WHEN 1 THEN 'CONTRACT' WHEN 2 THEN 'INTERNSHIP' WHEN 3 THEN 'PART_TIME' END END AS employment_type,
  CASE WHEN ld AND id % 5 = 0 THEN 'REMOTE' WHEN id % 4 = 0 THEN 'REMOTE' WHEN contains(lower(place), 'remote') THEN 'REMOTE' WHEN contains(lower(place), 'hybrid') THEN 'HYBRID' END AS work_mode,
  CAST(CASE WHEN ld THEN CASE WHEN id % 2 = 0 THEN 63440 ELSE 40000 END END AS DOUBLE) AS salary_min, CAST(CASE WHEN ld THEN CASE WHEN id % 2 = 0 THEN 83200 ELSE 50000 END END AS DOUBLE) AS salary_max, CASE WHEN ld THEN 'EUR' END AS salary_currency, 'FULL_SNAPSHOT' AS freshness_mode FROM x""", "canonical")  # fmt: skip
def source_icims(spark, d):
    c = view(spark, d, "canonical")
    lists = c.selectExpr("id div 20 AS g", f"{_ICROW} AS row").groupBy("g").agg(F.array_join(F.collect_list("row"), "\n").alias("html")).select(F.lit("careers-acme-labs").alias("token"), "html", F.lit(AS_OF).cast("timestamp_ntz").alias("fetched_at"))
    page = "'<div class=\"iCIMS_JobContent\"><p>Read<br>this</p></div>'"
    details = c.selectExpr("concat('https://careers-acme-labs.icims.com/jobs/', id, '/role-', id, '/job') AS url", f"CASE id % 3 WHEN 1 THEN {_ICLD} WHEN 2 THEN {page} END AS html").where("html IS NOT NULL")
    return shown(markup.icims(lists, details))
