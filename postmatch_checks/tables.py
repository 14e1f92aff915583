"""Input tables of the registered queries.

The supplied prose holds almost no skill, years or degree terms, so each document
gets a short tail that does. Whole documents are used, every one of them; cards
without a description come from the supplier table. The same SQL text runs in
Spark (through placeholders) and in the comparison engine (over views).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmatch.sources.postings import spread
from postmatch.sources.profiles import assemble, readable

POSTINGS = """
SELECT doc_id AS posting_id,
 CASE WHEN doc_id % 6 = 0 THEN 'Browser Automation Engineer'
      WHEN doc_id % 6 = 1 THEN 'Data Platform Developer'
      WHEN doc_id % 6 = 2 THEN 'Wedding Florist'
      WHEN doc_id % 6 = 3 THEN '  Front-End   <Web> Developer & "Lead" '
      WHEN doc_id % 6 = 4 THEN 'Test Lead' ELSE '' END AS job_title,
 CASE WHEN doc_id % 5 = 0 THEN ' ' WHEN doc_id % 5 = 1 THEN NULL
      WHEN doc_id % 5 = 2 THEN 'javascript:alert(1)'
      ELSE 'https://jobs.example.com/jobs/view/' || CAST(100000 + doc_id AS STRING) || '?a=1&b=2'
      END AS job_link,
 text
 || CASE WHEN doc_id % 6 = 0 THEN ' Robot Framework, Cypress and Playwright suites on Linux; REST API checks, MySQL fixtures, Git and Jenkins.'
         WHEN doc_id % 6 = 1 THEN ' Data platform developer for Airflow, ETL, Python, PostgreSQL, Kubernetes, AWS and CI/CD.'
         WHEN doc_id % 6 = 2 THEN ' Florist for weddings: bouquets, early deliveries, friendly counter service.'
         WHEN doc_id % 6 = 3 THEN ' JavaScript, TypeScript, Cypress, GraphQL, GitHub Actions; excellent digital taste.'
         WHEN doc_id % 6 = 4 THEN ' Manual testing, TestNG, Appium, BrowserStack, JMeter, Postman, Jira, BDD, Playwright, MongoDB, MySQL, Linux, Unix, Azure, Java, Flask, FastAPI.'
         ELSE '' END
 || CASE WHEN doc_id % 4 = 0 THEN ' Needs ' || CAST(doc_id % 9 AS STRING) || '+ years of experience.'
         WHEN doc_id % 4 = 1 THEN ' ' || CAST(doc_id % 5 AS STRING) || '-' || CAST(doc_id % 5 + 3 AS STRING) || ' yrs exp'
         WHEN doc_id % 4 = 2 THEN ' At least 2.5  years' ELSE '' END
 || CASE WHEN doc_id % 7 = 0 THEN ' Bachelor degree in Computer Science, AWS certified preferred.'
         WHEN doc_id % 7 = 1 THEN ' Master degree.' ELSE '' END AS job_description,
 lang AS location
FROM {documents}
UNION ALL
SELECT 1000000000 + s_suppkey, s_name, '',
 CASE WHEN s_acctbal < 0 THEN NULL WHEN s_acctbal < 5000 THEN '' ELSE '  ' END, 'none'
FROM {supplier}
"""

PROFILE_PARTS = """
SELECT CAST(profile_id AS BIGINT) AS profile_id, part_no, text FROM (VALUES
 (1, 0, ' Browser automation engineer, 5 years with Cypress, Playwright, Robot Framework and TypeScript.'),
 (1, 1, 'REST API checks, MySQL, Linux, Git, Jenkins and Jira; accessibility reviews. Computer science degree. '),
 (2, 1, 'Airflow, ETL, PostgreSQL, Kubernetes, AWS, CI/CD and Linux. AWS certified; master degree.'),
 (2, 0, 'Data platform developer, 3.5 yrs exp with Python.'),
 (3, 0, 'Florist: weddings, bouquets, deliveries. 10 years.'),
 (4, 0, 'the of and for'), (4, 1, NULL)
) AS p(profile_id, part_no, text)
"""

#: What a chat's writer can do, so that the chat's text serves as a profile.
CHAT_TAIL = """CASE WHEN profile_id % 5 = 0 THEN ' Browser automation engineer: Cypress, Playwright, Robot Framework, REST API, MySQL, Git, Jenkins, Linux. 6 years.'
 WHEN profile_id % 5 = 1 THEN ' Data platform developer, 4 yrs exp: Airflow, ETL, Python, PostgreSQL, Kubernetes, AWS, CI/CD. AWS certified, bachelor degree in computer science.'
 WHEN profile_id % 5 = 2 THEN ' Test lead: manual testing, TestNG, Appium, JMeter, Postman, Jira, BDD, Java, Azure. Master degree, 9 years.'
 WHEN profile_id % 5 = 3 THEN ' Front-end web developer: JavaScript, TypeScript, Cypress, GraphQL, GitHub Actions, Excel. 3 years.'
 ELSE ' Florist for weddings: bouquets, deliveries, counter service. 12 years.' END"""

VOCABULARY = """
SELECT lower(p_name) || '-' || CAST(p_partkey AS STRING) AS term FROM {part}
UNION ALL SELECT lower(p_name) FROM {part}
UNION ALL SELECT lower(p_type) FROM {part}
UNION ALL SELECT lower(p_brand) || ' ' || lower(p_type) || ' ' || CAST(p_size AS STRING) FROM {part}
UNION ALL SELECT 'c' UNION ALL SELECT 'the' UNION ALL SELECT ''
"""

TEXTS_WITH_PARTS = """
SELECT doc_id AS id, lower(text) || ' for ' || lower(p_name) || '-' || CAST(p_partkey AS STRING)
 || CASE WHEN doc_id % 3 = 0 THEN ', ' || lower(p_brand) || ' ' || lower(p_type) || ' ' || CAST(p_size AS STRING) ELSE '' END AS text
FROM {documents} JOIN {part} ON p_partkey = doc_id % 150
"""

CARD_PAGES = """
SELECT page_id, url, '<ul><li><a href="/home">Home</a></li></ul><MAIN class=x id=main-content>'
 || CASE WHEN page_id % 3 = 0 THEN replace(marked, '</li>', '')
         WHEN page_id % 3 = 1 THEN replace(replace(marked, '<li', '<LI'), '</li>', '</LI>')
         ELSE marked END
 || '</MAIN><ul><li>Imprint</li></ul>' AS html
FROM (SELECT page_id, url,
 CASE WHEN page_id % 4 = 0 THEN replace(html, '<li>', '<li data-job-id=' || CAST(500000 + page_id AS STRING) || '>')
      WHEN page_id % 4 = 1 THEN replace(html, '<li><a ', '<li><a data-job-id="' || CAST(600000 + page_id AS STRING) || '" ')
      WHEN page_id % 4 = 2 THEN replace(html, '<a href="/', '<A HREF="/jobs/view/' || CAST(700000 + page_id AS STRING) || '-')
      ELSE replace(html, '</a></li>', '</a><ul><li>in<b>ner</b></li></ul> tail</li>') END AS marked
FROM {pages})
"""

BASED_PAGES = """
SELECT page_id, url, '<!-- <base href="/no"> --><base target=_top><BASE HREF=''//base.example.org/d/x?a=1&amp;b#c''><base href="/late">'
 || html AS html FROM (""" + CARD_PAGES + ")"

CLASS_PAGES = """
SELECT page_id, replace(replace(html, '<article>',
 '<SECTION id=x class="clamp show-more-less-html__markup"><section>Lead</section>'), '</article>', '</SECTION>') AS html
FROM {pages}
"""

CARDS_WITH_IDS = """
SELECT doc_id AS posting_id,
 CASE WHEN source = 'src3' THEN '' ELSE 'j' || CAST(doc_id AS STRING) END AS job_id,
 CASE WHEN lang = 'fr' THEN '' WHEN lang = 'de' THEN NULL ELSE 'ui ' || text END AS ui_text
FROM {documents}
"""

FETCHED = """
SELECT 'j' || CAST(doc_id AS STRING) AS job_id, 'page' AS source,
 CASE WHEN n_chars % 7 = 0 THEN 429 WHEN n_chars % 7 = 1 THEN 403
      WHEN n_chars % 7 = 2 THEN 500 ELSE 200 END AS status,
 CASE WHEN n_chars % 7 <= 2 THEN NULL WHEN n_chars % 7 <= 4 THEN '' ELSE text END AS text
FROM {documents}
UNION ALL
SELECT 'j' || CAST(doc_id AS STRING), 'page',
 CASE WHEN n_chars % 7 = 0 OR n_chars % 7 = 5 THEN 200 ELSE 429 END,
 CASE WHEN n_chars % 7 = 0 OR n_chars % 7 = 5 THEN 'again ' || text END
FROM {documents} WHERE n_chars % 7 IN (0, 5, 6)
UNION ALL
SELECT 'j' || CAST(doc_id AS STRING), 'json',
 CASE WHEN n_chars % 5 = 0 THEN 429 ELSE 200 END,
 CASE WHEN n_chars % 5 = 0 THEN NULL WHEN n_chars % 5 = 1 THEN '' ELSE 'json ' || text END
FROM {documents}
"""

FETCHED_FOR_PAGES = """
SELECT CAST(500000 + page_id AS STRING) AS job_id, 'page' AS source,
 CASE WHEN page_id % 3 = 0 THEN 429 ELSE 200 END AS status,
 CASE WHEN page_id % 3 = 1 THEN 'from page of ' || url END AS text
FROM {pages}
UNION ALL
SELECT CAST(500000 + page_id AS STRING), 'json', 200, 'from json of ' || url FROM {pages}
UNION ALL
SELECT CAST(600000 + page_id AS STRING), 'json', 200, 'from json of ' || url FROM {pages}
"""

PAYLOADS = """
SELECT event_id,
 CASE WHEN event_type = 'error' THEN '{"error": "HTTP ' || CASE WHEN value < 10 THEN '429' ELSE '500' END || '"}'
      WHEN event_type = 'click' THEN '{"description": {"text": " posting ' || CAST(event_id AS STRING) || ' "}}'
      WHEN event_type = 'view' THEN '{"description": {}}'
      ELSE props END AS payload,
 props
FROM {events}
"""

SETTINGS = """
SELECT event_id, value,
 CASE WHEN value < 3 THEN ' Yes ' WHEN value < 6 THEN 'ON' WHEN value < 9 THEN 'off'
      WHEN value < 20 THEN NULL ELSE event_type END AS setting
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str, **given: DataFrame) -> DataFrame:
    """Run one of the texts above over the supplied tables, or over those ``given`` in their place."""
    names = ("documents", "supplier", "pages", "events", "part")
    used = {n: given[n] if n in given else table(spark, sf_dir, n) for n in names if "{" + n + "}" in sql}
    text = sql
    if used.keys() == {"events"}:  # JSON braces would clash with placeholders
        text = sql.replace("{events}", "\0").replace("{", "{{").replace("}", "}}")
        text = text.replace("\0", "{events}")
    return spark.sql(text, **used)


def texts_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their part. Only parts numbered as a remainder of 150 can be joined, so those
    are broadcast: a join by so few keys would exchange and sort every text."""
    near = F.broadcast(table(spark, sf_dir, "part").where("p_partkey BETWEEN -149 AND 149"))
    return derive(spark, sf_dir, TEXTS_WITH_PARTS, part=near)


def over_views(sql: str) -> str:
    """The same text over plain view names."""
    for name in ("documents", "supplier", "pages", "events", "part"):
        sql = sql.replace("{" + name + "}", name)
    return sql.strip()


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(derive(spark, sf_dir, POSTINGS))


def profile_parts(spark: SparkSession) -> DataFrame:
    return spark.sql(PROFILE_PARTS)


def profiles(spark: SparkSession) -> DataFrame:
    return readable(assemble(profile_parts(spark)))


def profile(spark: SparkSession, profile_id: int = 1) -> DataFrame:
    return profiles(spark).where(f"profile_id = {profile_id}")
