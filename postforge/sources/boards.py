"""Postings out of landed board payloads: one JSON document a file, or the open-data table of the national job bank.

A board is a schema, the list that holds its postings, and an expression for each column that isn't null. Adding one is
adding an entry. Files are read whole, each a row, parsed by the declared schema (never an inferred one) and exploded.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postforge.sources.tables import least

COLUMNS = {
    "source_id": "string", "source_url": "string", "title": "string", "company": "string", "location": "string", "description": "string", "apply_url": "string", "posted_at": "timestamp_ntz", "deadline": "timestamp_ntz",
    "employment_type": "string", "work_mode": "string", "salary_min": "double", "salary_max": "double", "salary_currency": "string",
}


@dataclass(frozen=True)
class Board:
    prefix: str
    schema: str
    items: str
    columns: dict[str, str]
    where: str = "true"
    freshness: str = "FULL_SNAPSHOT"
    #: Whether postings with one id are one posting.
    distinct: bool = field(default=False)
    #: The JSON in a payload that isn't all JSON.
    json: str = "payload"


def _t(c: str) -> str:
    """Trimmed, null if empty."""
    return f"nullif(trim({c}), '')"


def _type(c: str, **words: str) -> str:
    rules = words or {"intern": "INTERNSHIP", "contract": "CONTRACT", "temporary": "CONTRACT", "part": "PART_TIME", "full": "FULL_TIME"}
    return "CASE " + " ".join(f"WHEN contains(lower({c}), '{k.replace('_', '-')}') THEN '{v}'" for k, v in rules.items()) + " END"


def _mode(c: str) -> str:
    return f"CASE WHEN contains(lower({c}), 'remote') THEN 'REMOTE' WHEN contains(lower({c}), 'hybrid') THEN 'HYBRID' WHEN contains(lower({c}), 'on-site') OR contains(lower({c}), 'onsite') THEN 'ONSITE' WHEN contains(lower({c}), 'flex') THEN 'FLEXIBLE' END"


def _time(c: str) -> str:
    return f"CAST(try_to_timestamp({c}) AS TIMESTAMP_NTZ)"


def _join(sep: str, *cs: str) -> str:
    return f"array_join(filter(array({', '.join(_t(c) for c in cs)}), x -> x IS NOT NULL), '{sep}')"


def _remote_place(c: str) -> str:
    return f"CASE WHEN coalesce(trim({c}), '') = '' THEN 'Remote' WHEN {c} RLIKE '(?i)worldwide|anywhere' THEN 'Remote (Worldwide)' WHEN {c} RLIKE '(?i)north ?america' THEN 'Remote (North America)' WHEN {c} RLIKE '(?i)usa? ?only|^usa?$|united states' THEN 'Remote (US Only)' WHEN {c} RLIKE '(?i)canada' THEN 'Remote (Canada)' WHEN trim({c}) LIKE 'Remote%' THEN trim({c}) ELSE concat('Remote (', trim({c}), ')') END"


def _plain(c: str) -> str:
    """Text of HTML with the line ends of blocks and breaks."""
    c = f"regexp_replace(regexp_replace(regexp_replace({c}, '(?i)<br\\\\s*/?>', '\n'), '(?i)</?(p|div|li|ul|ol|h[1-6])[^>]*>', '\n'), '<[^>]+>', '')"
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\\'")):
        c = f"replace({c}, '{a}', '{b}')"
    return f"trim(BOTH '\n ' FROM regexp_replace({c}, '\n{{3,}}', '\n\n'))"


_TALEO = "concat('https://', split_part(token, '/', 1), '.taleo.net/careersection/', split_part(token, '/', 2), '/{}.ftl?job=', j.contestNo, '&lang=en')"
_NAME = "initcap(regexp_replace(token, '[-_]+', ' '))"

BOARDS = {
    "greenhouse": Board("Greenhouse", "jobs array<struct<id:bigint,absolute_url:string,title:string,company_name:string,location:struct<name:string>,content:string,first_published:string>>", "p.jobs", {
        "source_id": "CAST(j.id AS STRING)", "source_url": "j.absolute_url", "title": "j.title", "company": "j.company_name", "location": "coalesce(j.location.name, 'Unknown')", "description": "j.content", "apply_url": "j.absolute_url", "posted_at": _time("j.first_published"),
    }),
    "lever": Board("Lever", "array<struct<id:string,text:string,descriptionPlain:string,openingPlain:string,additionalPlain:string,salaryDescriptionPlain:string,applyUrl:string,hostedUrl:string,createdAt:bigint,categories:struct<commitment:string,location:string,allLocations:array<string>>,workplaceType:string,country:string,salaryRange:struct<min:double,max:double,currency:string>>>", "p", {
        "source_id": "j.id", "source_url": "coalesce(j.hostedUrl, j.applyUrl)", "title": "j.text", "company": _NAME,
        "location": f"coalesce(nullif(array_join(array_distinct(filter(transform(j.categories.allLocations, x -> trim(x)), x -> x <> '')), ', '), ''), {_t('j.categories.location')}, {_t('j.country')}, 'Unknown')",
        "description": _join("\n\n", "j.descriptionPlain", "j.openingPlain", "j.additionalPlain", "j.salaryDescriptionPlain"), "apply_url": "coalesce(j.applyUrl, j.hostedUrl, '')", "posted_at": "CAST(timestamp_millis(j.createdAt) AS TIMESTAMP_NTZ)",
        "employment_type": _type("j.categories.commitment"), "work_mode": _mode("j.workplaceType"), "salary_min": "j.salaryRange.min", "salary_max": "j.salaryRange.max", "salary_currency": "j.salaryRange.currency",
    }),
    "recruitee": Board("Recruitee", "offers array<struct<id:bigint,guid:string,slug:string,title:string,company_name:string,description:string,requirements:string,careers_url:string,careers_apply_url:string,city:string,country:string,state_name:string,location:string,remote:boolean,hybrid:boolean,on_site:boolean,published_at:string,updated_at:string,close_at:string,employment_type_code:string,status:string,salary:struct<min:string,max:string,currency:string>,locations:array<struct<name:string,city:string,state:string,country:string>>>>", "p.offers", {
        "source_id": "coalesce(j.guid, CAST(j.id AS STRING))", "source_url": "coalesce(j.careers_url, concat('https://', token, '.recruitee.com/', coalesce(concat('o/', j.slug), '')))", "title": "j.title", "company": f"coalesce({_t('j.company_name')}, {_NAME})",
        "location": f"coalesce(nullif(array_join(array_distinct(filter(transform(j.locations, l -> CASE WHEN l.name RLIKE '(?i)remote' THEN trim(l.name) ELSE concat_ws(', ', {_t('l.city')}, {_t('l.state')}, {_t('l.country')}) END), x -> x <> '')), ' | '), ''), {_t('j.location')}, nullif(concat_ws(', ', {_t('j.city')}, {_t('j.state_name')}, {_t('j.country')}), ''), 'Unknown')",
        "description": f"concat_ws('\n\n', concat('<h2>Role</h2>\n', {_t('j.description')}), concat('<h2>Requirements</h2>\n', {_t('j.requirements')}))", "apply_url": "coalesce(j.careers_apply_url, j.careers_url, concat('https://', token, '.recruitee.com/', coalesce(concat('o/', j.slug), '')))",
        "posted_at": _time("coalesce(j.published_at, j.updated_at)"), "deadline": _time("j.close_at"), "employment_type": _type("j.employment_type_code", intern="INTERNSHIP", contract="CONTRACT", temporary="CONTRACT", parttime="PART_TIME", fulltime="FULL_TIME"),
        "work_mode": "CASE WHEN j.hybrid THEN 'HYBRID' WHEN j.remote THEN 'REMOTE' WHEN j.on_site THEN 'ONSITE' END", "salary_min": "try_cast(j.salary.min AS DOUBLE)", "salary_max": "try_cast(j.salary.max AS DOUBLE)", "salary_currency": _t("j.salary.currency"),
    }, where="coalesce(j.status, 'published') IN ('published', '')"),
    "rippling": Board("Rippling", "array<struct<uuid:string,name:string,url:string,department:struct<label:string>,workLocation:struct<label:string>>>", "p", {
        "source_id": "j.uuid", "source_url": "j.url", "title": "j.name", "company": _NAME, "location": r"coalesce(nullif(trim(regexp_extract(j.workLocation.label, '\\(([^)]+)\\)', 1)), ''), " + _t("j.workLocation.label") + ", 'Unknown')", "apply_url": "j.url", "work_mode": _mode("split_part(j.workLocation.label, '(', 1)"),
        "description": f"concat_ws('\n', concat('Department: ', {_t('j.department.label')}), concat('Work location: ', {_t('j.workLocation.label')}))",
    }),
    "smartrecruiters": Board("SmartRecruiters", "content array<struct<id:string,name:string,releasedDate:string,postingUrl:string,applyUrl:string,location:struct<city:string,region:string,country:string,remote:boolean,hybrid:boolean,fullLocation:string>,company:struct<name:string>,department:struct<label:string>,function:struct<label:string>,industry:struct<label:string>,typeOfEmployment:struct<label:string>,experienceLevel:struct<label:string>>>", "p.content", {
        "source_id": "j.id", "source_url": "j.postingUrl", "title": "j.name", "company": f"coalesce({_t('j.company.name')}, {_NAME})", "location": f"coalesce({_t('j.location.fullLocation')}, nullif(concat_ws(', ', {_t('j.location.city')}, {_t('j.location.region')}, {_t('j.location.country')}), ''), 'Unknown')",
        "description": _join(" · ", "j.function.label", "j.department.label", "j.industry.label", "j.experienceLevel.label"), "apply_url": "coalesce(j.applyUrl, j.postingUrl, '')", "posted_at": _time("j.releasedDate"),
        "employment_type": _type("j.typeOfEmployment.label", intern="INTERNSHIP", contract="CONTRACT", temporary="CONTRACT", part="PART_TIME", full="FULL_TIME", permanent="FULL_TIME"), "work_mode": "CASE WHEN j.location.remote THEN 'REMOTE' WHEN j.location.hybrid THEN 'HYBRID' END",
    }),
    "workable": Board("Workable", "name string, description string, jobs array<struct<title:string,shortcode:string,code:string,url:string,application_url:string,employment_type:string,work_place:string,remote:boolean,created_at:string,published:string,description:string,short_description:string,department:string,location:struct<city:string,region:string,country:string,location_str:string>,state:string>>", "p.jobs", {
        "source_id": "coalesce(j.shortcode, j.code, j.title)", "source_url": "coalesce(j.url, concat('https://apply.workable.com/', token, '/', coalesce(concat('j/', coalesce(j.shortcode, j.code), '/'), '')))", "title": "j.title", "company": f"coalesce({_t('p.name')}, {_NAME})",
        "location": f"coalesce({_t('j.location.location_str')}, nullif(concat_ws(', ', {_t('j.location.city')}, {_t('j.location.region')}, coalesce({_t('j.location.country')}, {_t('j.state')})), ''), CASE WHEN j.remote THEN 'Remote' ELSE 'Unknown' END)",
        "description": _join("\n\n", "j.short_description", "j.description", "j.department", "p.description"), "apply_url": "coalesce(j.application_url, j.url, concat('https://apply.workable.com/', token, '/', coalesce(concat('j/', coalesce(j.shortcode, j.code), '/'), '')))",
        "posted_at": _time("coalesce(j.published, j.created_at)"), "employment_type": _type("j.employment_type"), "work_mode": f"CASE WHEN j.remote THEN 'REMOTE' ELSE {_mode(chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', j.work_place, j.location.location_str, j.state)')} END",
    }, where="trim(j.title) <> ''"),
    "jobicy": Board("Jobicy", "jobs array<struct<id:bigint,url:string,jobTitle:string,companyName:string,jobType:array<string>,jobGeo:string,jobExcerpt:string,jobDescription:string,pubDate:string,annualSalaryMin:string,annualSalaryMax:string,salaryCurrency:string>>", "p.jobs", {
        "source_id": "concat('jobicy:', j.id)", "source_url": "j.url", "title": "trim(j.jobTitle)", "company": f"coalesce({_t('j.companyName')}, 'Unknown Company')", "location": _remote_place("j.jobGeo"), "description": "coalesce(j.jobDescription, j.jobExcerpt, '')", "apply_url": "coalesce(j.url, '')", "posted_at": _time("j.pubDate"),
        "employment_type": _type("array_join(j.jobType, ' ')", contract="CONTRACT", part_time="PART_TIME", internship="INTERNSHIP"), "work_mode": "'REMOTE'", "salary_min": "nullif(try_cast(j.annualSalaryMin AS DOUBLE), 0)", "salary_max": "nullif(try_cast(j.annualSalaryMax AS DOUBLE), 0)", "salary_currency": f"coalesce({_t('j.salaryCurrency')}, CASE WHEN coalesce(j.annualSalaryMin, j.annualSalaryMax) IS NOT NULL THEN 'USD' END)",
    }, where="j.id IS NOT NULL AND trim(j.jobTitle) <> ''", distinct=True),
    "remoteok": Board("RemoteOK", "array<struct<slug:string,id:string,epoch:bigint,date:string,company:string,position:string,description:string,location:string,salary_min:double,salary_max:double,url:string,apply_url:string>>", "p", {
        "source_id": "concat('remoteok:', j.id)", "source_url": "coalesce(j.url, concat('https://remoteok.com/remote-jobs/', coalesce(j.slug, j.id)))", "title": "trim(j.position)", "company": "trim(j.company)", "location": _remote_place("j.location"), "description": "coalesce(j.description, '')", "apply_url": "coalesce(j.apply_url, j.url, concat('https://remoteok.com/remote-jobs/', coalesce(j.slug, j.id)))",
        "posted_at": f"coalesce({_time('j.date')}, CAST(timestamp_seconds(j.epoch) AS TIMESTAMP_NTZ))", "work_mode": "'REMOTE'", "salary_min": "nullif(j.salary_min, 0)", "salary_max": "nullif(j.salary_max, 0)", "salary_currency": "CASE WHEN j.salary_min > 0 OR j.salary_max > 0 THEN 'USD' END",
        "employment_type": "CASE WHEN concat_ws(' ', j.position, left(j.description, 500)) RLIKE '(?i)\\\\bcontract\\\\b' THEN 'CONTRACT' WHEN concat_ws(' ', j.position, left(j.description, 500)) RLIKE '(?i)\\\\bpart[- ]?time\\\\b' THEN 'PART_TIME' WHEN concat_ws(' ', j.position, left(j.description, 500)) RLIKE '(?i)\\\\bintern(ship)?\\\\b' THEN 'INTERNSHIP' END",
    }, where="j.position <> '' AND j.id <> '' AND j.company <> ''"),
    "remotive": Board("Remotive", "jobs array<struct<id:bigint,url:string,title:string,company_name:string,job_type:string,publication_date:string,candidate_required_location:string,salary:string,description:string>>", "p.jobs", {
        "source_id": "concat('remotive:', j.id)", "source_url": "j.url", "title": "trim(j.title)", "company": "trim(j.company_name)", "location": _remote_place("j.candidate_required_location"), "description": "coalesce(j.description, '')", "apply_url": "j.url", "posted_at": _time("j.publication_date"), "work_mode": "'REMOTE'",
        "employment_type": _type("j.job_type", contract="CONTRACT", freelance="CONTRACT", part="PART_TIME", intern="INTERNSHIP", full="FULL_TIME"),
        "salary_min": "try_element_at(transform(regexp_extract_all(j.salary, '([0-9]+(?:[.][0-9]+)? ?[kK]?)', 1), x -> CAST(regexp_extract(x, '([0-9.]+)', 1) AS DOUBLE) * IF(lower(x) LIKE '%k', 1000, 1)), 1)",
        "salary_max": "coalesce(try_element_at(transform(regexp_extract_all(j.salary, '([0-9]+(?:[.][0-9]+)? ?[kK]?)', 1), x -> CAST(regexp_extract(x, '([0-9.]+)', 1) AS DOUBLE) * IF(lower(x) LIKE '%k', 1000, 1)), 2), try_element_at(transform(regexp_extract_all(j.salary, '([0-9]+(?:[.][0-9]+)? ?[kK]?)', 1), x -> CAST(regexp_extract(x, '([0-9.]+)', 1) AS DOUBLE) * IF(lower(x) LIKE '%k', 1000, 1)), 1))",
        "salary_currency": "CASE WHEN j.salary RLIKE '[0-9]' THEN IF(j.salary RLIKE '(?i)eur|€', 'EUR', 'USD') END",
    }, where="j.id IS NOT NULL AND j.title <> '' AND j.company_name <> '' AND j.url <> ''"),
    "themuse": Board("TheMuse", "results array<struct<id:bigint,name:string,type:string,publication_date:string,contents:string,refs:struct<landing_page:string>,company:struct<name:string>,locations:array<struct<name:string>>>>", "p.results", {
        "source_id": "concat('themuse:', j.id)", "source_url": "j.refs.landing_page", "title": "trim(j.name)", "company": f"coalesce({_t('j.company.name')}, 'Unknown Company')", "description": "coalesce(j.contents, '')", "apply_url": "coalesce(j.refs.landing_page, '')", "posted_at": _time("j.publication_date"),
        "location": "CASE WHEN size(filter(j.locations.name, x -> x <> '')) <= 0 THEN 'Unknown' WHEN exists(j.locations.name, x -> x RLIKE '(?i)remote|flexible') AND forall(j.locations.name, x -> x RLIKE '(?i)remote|flexible') THEN 'Remote' WHEN exists(j.locations.name, x -> x RLIKE '(?i)remote|flexible') THEN concat('Hybrid/Remote (', array_join(slice(filter(j.locations.name, x -> NOT x RLIKE '(?i)remote|flexible'), 1, 3), '; '), ')') ELSE array_join(slice(j.locations.name, 1, 3), '; ') END",
        "work_mode": "CASE WHEN exists(j.locations.name, x -> x RLIKE '(?i)remote|flexible') THEN IF(forall(j.locations.name, x -> x RLIKE '(?i)remote|flexible'), 'REMOTE', 'HYBRID') ELSE 'ONSITE' END", "employment_type": _type("j.type", intern="INTERNSHIP", contract="CONTRACT", freelance="CONTRACT", part="PART_TIME"),
    }, where="j.id IS NOT NULL AND j.name <> ''", distinct=True),
    "usajobs": Board("USAJobs", "SearchResult struct<SearchResultItems:array<struct<MatchedObjectDescriptor:struct<PositionID:string,PositionTitle:string,PositionURI:string,PositionLocation:array<struct<LocationName:string,CityName:string,CountrySubDivisionCode:string>>,OrganizationName:string,DepartmentName:string,PositionSchedule:array<struct<Name:string>>,PositionOfferingType:array<struct<Name:string>>,PositionRemuneration:array<struct<MinimumRange:string,MaximumRange:string>>,QualificationSummary:string,PublicationStartDate:string,ApplicationCloseDate:string,UserArea:struct<Details:struct<JobSummary:string,MajorDuties:array<string>,TeleworkEligible:boolean>>>>>>", "transform(p.SearchResult.SearchResultItems, x -> x.MatchedObjectDescriptor)", {
        "source_id": "concat('usajobs:', j.PositionID)", "source_url": "j.PositionURI", "title": "trim(j.PositionTitle)", "company": f"CASE WHEN {_t('j.OrganizationName')} <> {_t('j.DepartmentName')} THEN concat(trim(j.OrganizationName), ' (', trim(j.DepartmentName), ')') ELSE coalesce({_t('j.OrganizationName')}, {_t('j.DepartmentName')}, 'US Federal Government') END",
        "location": "coalesce(nullif(array_join(filter(transform(slice(j.PositionLocation, 1, 3), l -> CASE WHEN l.CityName <> '' AND l.CountrySubDivisionCode <> '' THEN concat(trim(l.CityName), ', ', trim(l.CountrySubDivisionCode)) ELSE coalesce(trim(l.LocationName), '') END), x -> x <> ''), '; '), '') || IF(size(j.PositionLocation) > 3, concat(' (+', size(j.PositionLocation) - 3, ' more)'), ''), 'United States')",
        "description": "coalesce(nullif(concat_ws('\n\n', j.UserArea.Details.JobSummary, 'Qualifications:\n' || j.QualificationSummary, 'Major Duties:\n' || nullif(array_join(transform(j.UserArea.Details.MajorDuties, x -> '• ' || x), '\n'), '')), ''), 'See full posting for details.')", "apply_url": "coalesce(j.PositionURI, concat('https://www.usajobs.gov/job/', j.PositionID))", "posted_at": _time("j.PublicationStartDate"), "deadline": _time("j.ApplicationCloseDate"),
        "employment_type": "CASE WHEN lower(try_element_at(j.PositionSchedule, 1).Name) LIKE '%part-time%' THEN 'PART_TIME' WHEN lower(try_element_at(j.PositionSchedule, 1).Name) LIKE '%intermittent%' THEN 'CONTRACT' WHEN lower(try_element_at(j.PositionOfferingType, 1).Name) RLIKE 'term|temporary' THEN 'CONTRACT' WHEN lower(try_element_at(j.PositionOfferingType, 1).Name) LIKE '%internship%' THEN 'INTERNSHIP' END",
        "work_mode": "CASE WHEN j.UserArea.Details.TeleworkEligible THEN 'HYBRID' END", "salary_min": "nullif(try_cast(try_element_at(j.PositionRemuneration, 1).MinimumRange AS DOUBLE), 0)", "salary_max": "nullif(try_cast(try_element_at(j.PositionRemuneration, 1).MaximumRange AS DOUBLE), 0)", "salary_currency": "CASE WHEN try_element_at(j.PositionRemuneration, 1).MinimumRange IS NOT NULL THEN 'USD' END",
    }, where="j.PositionID <> ''", distinct=True),
    "adzuna": Board("Adzuna", "results array<struct<id:string,title:string,description:string,company:struct<display_name:string>,location:struct<display_name:string>,redirect_url:string,created:string,salary_min:double,salary_max:double,salary_is_predicted:string,contract_time:string,contract_type:string>>", "p.results", {
        "source_id": "concat('adzuna:', token, ':', j.id)", "source_url": "j.redirect_url", "title": "trim(j.title)", "company": f"coalesce({_t('j.company.display_name')}, 'Unknown Company')", "location": f"coalesce({_t('j.location.display_name')}, 'Unknown')", "description": "coalesce(j.description, '')", "apply_url": "coalesce(j.redirect_url, '')", "posted_at": _time("j.created"),
        "employment_type": _type("concat_ws(' ', j.contract_type, j.contract_time)", contract="CONTRACT", part="PART_TIME", full="FULL_TIME"), "work_mode": "CASE WHEN contains(lower(concat_ws(' ', j.title, j.description, j.location.display_name)), 'hybrid') THEN 'HYBRID' WHEN contains(lower(concat_ws(' ', j.title, j.description, j.location.display_name)), 'remote') THEN 'REMOTE' END",
        "salary_min": "CASE WHEN coalesce(j.salary_is_predicted, '0') <> '1' THEN nullif(j.salary_min, 0) END", "salary_max": "CASE WHEN coalesce(j.salary_is_predicted, '0') <> '1' THEN nullif(j.salary_max, 0) END", "salary_currency": "CASE WHEN coalesce(j.salary_min, j.salary_max) > 0 THEN IF(token = 'ca', 'CAD', 'USD') END",
    }, where="j.id <> '' AND j.title <> '' AND NOT coalesce(concat_ws(' ', j.company.display_name, j.title) RLIKE '(?i)targeted talent|teksystems|allegis group', false)"),
    "himalayas": Board("Himalayas", "jobs array<struct<id:string,guid:string,title:string,companyName:string,employmentType:string,description:string,applicationLink:string,pubDate:string,expiryDate:string,minSalary:double,maxSalary:double,locationRestrictions:array<string>>>", "p.jobs", {
        "source_id": "concat('himalayas:', coalesce(j.guid, j.id, j.title))", "source_url": "j.applicationLink", "title": "trim(j.title)", "company": f"coalesce({_t('j.companyName')}, 'Unknown Company')", "location": "coalesce(concat('Remote (', nullif(array_join(j.locationRestrictions, ', '), ''), ')'), 'Remote')", "description": "coalesce(j.description, '')", "apply_url": "coalesce(j.applicationLink, '')",
        "posted_at": _time("j.pubDate"), "deadline": _time("j.expiryDate"), "employment_type": _type("j.employmentType"), "work_mode": "'REMOTE'", "salary_min": "nullif(j.minSalary, 0)", "salary_max": "nullif(j.maxSalary, 0)", "salary_currency": "CASE WHEN coalesce(j.minSalary, j.maxSalary) > 0 THEN 'USD' END",
    }, where="j.title <> ''", distinct=True),
    "ashby": Board("Ashby", "jobBoard struct<jobPostings:array<struct<id:string,title:string,updatedAt:string,publishedDate:string,applicationDeadline:string,locationName:string,workplaceType:string,employmentType:string,isListed:boolean,departmentName:string,teamName:string,secondaryLocations:array<struct<locationName:string>>>>>", "p.jobBoard.jobPostings", {
        "source_id": "j.id", "source_url": "concat('https://jobs.ashbyhq.com/', token, '/', j.id)", "title": "j.title", "company": _NAME, "apply_url": "concat('https://jobs.ashbyhq.com/', token, '/', j.id)", "posted_at": _time("coalesce(j.publishedDate, j.updatedAt)"), "deadline": _time("j.applicationDeadline"),
        "location": "coalesce(nullif(array_join(array_distinct(filter(concat(array(trim(j.locationName)), coalesce(transform(j.secondaryLocations, x -> trim(x.locationName)), array())), x -> x <> '')), ', '), ''), 'Unknown')", "description": f"concat_ws('\n', concat('Team: ', {_t('j.teamName')}), concat('Department: ', {_t('j.departmentName')}))",
        "employment_type": _type("j.employmentType", intern="INTERNSHIP", contract="CONTRACT", temp="CONTRACT", part="PART_TIME", full="FULL_TIME"), "work_mode": _mode("j.workplaceType"),
    }, where="coalesce(j.isListed, true)", json="regexp_extract(payload, '(?s)window[.]__appData *= *([{].*?[}]) *; *(?:\n|</script>)', 1)"),
    "workday": Board("Workday", "jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,remoteType:string,bulletFields:array<string>>>", "p.jobPostings", {
        "source_id": "coalesce(try_element_at(filter(j.bulletFields, x -> x RLIKE '[0-9]'), 1), j.externalPath)", "source_url": "concat('https://', split_part(token, '/', 1), '/', split_part(token, '/', 3), j.externalPath)", "title": "j.title", "company": "initcap(regexp_replace(split_part(token, '/', 2), '[-_]+', ' '))", "location": f"coalesce({_t('j.locationsText')}, 'Unknown')",
        "apply_url": "concat('https://', split_part(token, '/', 1), '/', split_part(token, '/', 3), j.externalPath)", "work_mode": _mode("j.remoteType"), "description": "concat_ws('\n', array_join(j.bulletFields, '\n'))",
        "posted_at": "CASE WHEN j.postedOn RLIKE '(?i)today' THEN fetched_at WHEN j.postedOn RLIKE '(?i)yesterday' THEN timestampadd(DAY, -1, fetched_at) WHEN j.postedOn RLIKE '(?i)[0-9]+[+]? days? ago' THEN timestampadd(DAY, -CAST(regexp_extract(j.postedOn, '([0-9]+)', 1) AS INT), fetched_at) END",
    }, where="j.externalPath <> ''"),
    "taleo": Board("Taleo", "requisitionList array<struct<contestNo:string,title:string,location:string,postingDate:string,openingDate:string,closingDate:string,description:string,qualifications:string,additionalInfo:string>>", "p.requisitionList", {
        "source_id": "concat('taleo:', split_part(token, '/', 1), ':', j.contestNo)", "source_url": _TALEO.format("jobdetail"), "apply_url": _TALEO.format("jobapply"), "title": f"coalesce({_t('j.title')}, 'Untitled Position')", "company": "initcap(regexp_replace(split_part(token, '/', 1), '[-_]+', ' '))",
        "location": f"coalesce({_t('j.location')}, 'Not specified')", "description": _plain("array_join(filter(array(j.description, j.qualifications, j.additionalInfo), x -> x <> ''), '\n\n')"), "posted_at": _time("coalesce(j.postingDate, j.openingDate)"), "deadline": _time("j.closingDate"),
    }),
}


def parse(payloads: DataFrame, board: str) -> DataFrame:
    """Postings of a board's payloads (columns token, payload, fetched_at). A payload that isn't JSON of the board's form has none."""
    b = BOARDS[board]
    rows = payloads.select("token", "fetched_at", F.from_json(F.expr(b.json), b.schema).alias("p")).select("token", "fetched_at", "p", F.explode(F.expr(b.items)).alias("j")).where(b.where)
    out = rows.select(
        F.concat_ws(":", F.lit(b.prefix), "token").alias("source_name"), *[(F.expr(b.columns[c]) if c in b.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()], F.lit(b.freshness).alias("freshness_mode"), "fetched_at",
    )
    out = out.where("source_id IS NOT NULL")  # an empty object parses as a posting without anything
    return least(out, ["source_name", "source_id"], ["fetched_at"]) if b.distinct else out


def read(spark: SparkSession, path: str, board: str, token: str, fetched_at: str) -> DataFrame:
    """Postings of the payload files below path."""
    files = spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")
    return parse(files.withColumns({"token": F.lit(token), "fetched_at": F.lit(fetched_at).cast("timestamp_ntz")}), board)


def read_job_bank(spark: SparkSession, path: str, fetched_at: str) -> DataFrame:
    """The job bank's table: UTF-16LE, tab-separated, with `NA` and `*No data` for missing values. Rows without id or title are left out; wages are made annual."""
    return job_bank(spark.read.option("sep", "\t").option("encoding", "UTF-16LE").option("lineSep", "\n").option("header", True).option("quote", "").csv(path), fetched_at)


def job_bank(raw: DataFrame, fetched_at: str) -> DataFrame:
    """Postings of the job bank's rows, all columns text and named as in its files."""
    names = {c.strip().lstrip("﻿").lower(): c for c in raw.columns}

    def get(name: str):
        v = F.regexp_replace(raw[f"`{names[name.lower()]}`"], r"^\s+|\s+$", "") if name.lower() in names else F.lit(None).cast("string")
        return F.when(~v.isin("", "NA", "*No data"), v)

    title = F.coalesce(get("Job Title"), get("Original Job Title"))
    key, per = get("WIC Job Location Snapshot ID"), F.lower(get("Salary Per"))
    times = F.when(per == "hour", 2080).when(per == "week", 52).when(per == "month", 12)
    low, high = get("Salary Minimum").try_cast("double"), get("Salary Maximum").try_cast("double")
    yearly = lambda c: F.when(times.isNotNull() & low.isNotNull(), F.floor(c * times + 0.5).cast("double")).otherwise(c)
    kind = F.lower(get("Employment Type"))
    said = [("Position: ", title), ("Occupation: ", F.coalesce(get("NOC21 Code Name"), get("NOC 2016 Code Name"))), ("Education: ", get("Education LOS")), ("Experience: ", get("Experience Level")), ("Term: ", get("Employment Term")), ("Hours: ", get("Work Hours"))]
    url = F.concat(F.lit("https://www.jobbank.gc.ca/jobsearch/jobposting/"), key)
    return raw.where(title.isNotNull() & key.isNotNull()).select(
        F.lit("JobBank:open-data").alias("source_name"), F.concat(F.lit("jobbank:"), key).alias("source_id"), url.alias("source_url"), title.alias("title"), F.coalesce(get("NAICS"), F.lit("Job Bank Employer")).alias("company"),
        F.concat_ws(", ", get("City"), get("Province/Territory"), F.lit("Canada")).alias("location"), F.concat_ws("\n", *[F.concat(F.lit(a), c) for a, c in said]).alias("description"), url.alias("apply_url"),
        F.try_to_timestamp(get("First Posting Date")).cast("timestamp_ntz").alias("posted_at"), F.lit(None).cast("timestamp_ntz").alias("deadline"),
        F.when(kind.contains("full time"), "FULL_TIME").when(kind.contains("part time"), "PART_TIME").alias("employment_type"), F.when(F.lower(get("Employment Term Telework")).isin("yes", "1"), "REMOTE").alias("work_mode"),
        yearly(low).alias("salary_min"), yearly(high).alias("salary_max"), F.when(low.isNotNull(), "CAD").alias("salary_currency"), F.lit("INCREMENTAL").alias("freshness_mode"), F.lit(fetched_at).cast("timestamp_ntz").alias("fetched_at"),
    )


def site_listings(starts: DataFrame, landed: DataFrame, depth: int = 7) -> DataFrame:
    """The landed pages (token, company, url, html, fetched_at) that are a site's lists: those of starts (token, url), and the further pages that they lead to. What company_site() reads."""
    from postforge.operators import pages

    keys = pages.reached(starts, landed, depth).select("token", "url")
    return least(landed, ["token", "url"], ["fetched_at"]).join(keys, ["token", "url"], "left_semi").select(*landed.columns)


def company_site(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Postings of company sites. listings, details: token, company, url, html, fetched_at of landed pages.

    A page's structured data goes before data embedded in its scripts; where neither says anything, the detail pages that its
    links lead to are read, by their own structured data or else by heading and text. A posting is known by its requisition, else by URL and title.
    """
    from postforge.operators import pages

    c = F.col

    def found(df: DataFrame) -> DataFrame:
        jobs = F.concat(pages.structured(c("html"), c("url"), False), pages.structured(c("html"), c("url"), True))
        return df.withColumn("jobs", jobs)

    lists = found(listings)
    own = lists.select("token", "company", "fetched_at", F.explode("jobs").alias("j")).select("token", "fetched_at", F.coalesce("j.company", "company").alias("company"), "j.title", "j.location", "j.description", "j.source_url", "j.apply_url", "j.posted", "j.due", "j.requisition")
    open_ = lists.where(F.size("jobs") == 0).select(c("token").alias("_t"), F.explode(pages.job_links(c("html"), c("url"))["href"]).alias("_u")).distinct()
    read = found(details.join(open_, (c("token") == c("_t")) & (c("url") == c("_u")), "left_semi"))
    plain = F.when(F.size("jobs") == 0, pages.detail(c("html"), c("url")))
    read = read.withColumn("d", plain)
    by_data = read.select("token", "company", "fetched_at", F.explode("jobs").alias("j")).select("token", "fetched_at", F.coalesce("j.company", "company").alias("company"), "j.title", "j.location", "j.description", "j.source_url", "j.apply_url", "j.posted", "j.due", "j.requisition")
    by_text = read.where("d IS NOT NULL").select("token", "fetched_at", "company", "d.title", "d.location", "d.description", c("url").alias("source_url"), "d.apply_url", "d.posted", "d.due", F.lit(None).cast("string").alias("requisition"))
    df = own.union(by_data).union(by_text)
    text = F.concat_ws("\n", "title", "description")
    pay = r"([$£€])\s?(\d[\d,]{2,})\s*(?:-|–|—|to)\s*(?:[$£€])?\s?(\d[\d,]{2,})"
    money = lambda i: F.replace(F.regexp_extract("description", pay, i), F.lit(","), F.lit("")).try_cast("double")
    sign = F.regexp_extract("description", pay, 1)
    word = lambda p: text.rlike(rf"(?i)\b({p})\b")
    when = lambda n: F.coalesce(F.try_to_timestamp(c(n)), F.try_to_timestamp(c(n), F.lit("MMMM d, yyyy")), F.try_to_timestamp(c(n), F.lit("MMM d, yyyy")), F.try_to_timestamp(c(n), F.lit("MMMM d yyyy")))
    values = {
        "source_id": F.concat(F.lit("company:"), F.coalesce("requisition", F.sha2(F.concat_ws("|", "source_url", "title"), 256))), "source_url": c("source_url"), "title": c("title"), "company": c("company"), "location": F.coalesce("location", F.lit("Unknown")), "description": c("description"),
        "apply_url": c("apply_url"), "posted_at": when("posted"), "deadline": when("due"), "employment_type": F.when(word("intern(ship)?"), "INTERNSHIP").when(word("contract"), "CONTRACT").when(word("part[- ]?time"), "PART_TIME"),
        "work_mode": F.when(word("hybrid"), "HYBRID").when(word("remote"), "REMOTE").when(word("on[- ]site|in office"), "ONSITE"), "salary_min": money(2), "salary_max": money(3), "salary_currency": F.when(sign == "$", "USD").when(sign == "£", "GBP").when(sign == "€", "EUR"),
    }
    cols = [values[k].cast(t).alias(k) for k, t in COLUMNS.items()]
    out = df.select(F.concat(F.lit("CompanySite:"), "token").alias("source_name"), *cols, F.lit("INCREMENTAL").alias("freshness_mode"), "fetched_at")
    return least(out, ["source_name", "source_id"], ["fetched_at"])


def seed_urls(lines: DataFrame) -> DataFrame:
    """Distinct URLs of a seed file (column value): a JSON object's first URL field, else every URL of the line."""
    from postforge.functions.urls import urls_in

    fields = ("url", "careersUrl", "boardUrl", "website", "homepage", "link", "href")
    own = F.coalesce(*[F.get_json_object(F.when(F.trim("value").startswith("{"), F.col("value")), f"$.{f}") for f in fields])
    return lines.select(F.explode(F.when(own.isNotNull(), F.array(own)).otherwise(urls_in(F.col("value")))).alias("url")).distinct()
