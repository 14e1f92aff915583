"""Fixed values that results depend on.

Every value here must stay exactly as it is for scores to come out right. The
vocabularies and weights can be replaced through
:class:`postmatch.options.MatchOptions`, marks of pages by arguments.
"""

# --- fixed values: skill vocabulary ---------------------------------------
SKILLS = (
    "accessibility", "agile", "airflow", "api", "appium", "aws", "azure", "bdd",
    "browserstack", "ci/cd", "cypress", "docker", "etl", "excel", "fastapi",
    "flask", "git", "github actions", "graphql", "java", "javascript", "jenkins",
    "jira", "jmeter", "kubernetes", "linux", "manual testing", "microservices",
    "mongodb", "mysql", "playwright", "postgresql", "postman", "pytest", "python",
    "qa", "rest api", "robot framework", "selenium", "sql", "test automation",
    "testng", "typescript", "unix",
)

# --- fixed values: education and certificate vocabulary --------------------
EDUCATION_TERMS = (
    "aws certified", "azure certified", "b.tech", "bachelor", "btech", "certified",
    "computer science", "degree", "istqb", "master",
)

# --- fixed values: patterns -------------------------------------------------
TOKEN_PATTERN = r"[a-z][a-z0-9+#./-]*"
#: The tokens of more than two characters.
LONG_TOKEN_PATTERN = r"[a-z][a-z0-9+#./-][a-z0-9+#./-]+"
YEARS_PATTERN = (
    r"(\d+(?:\.\d+)?)\s*\+?\s*(?:years?|yrs?)\s*(?:of)?\s*(?:experience|exp)?"
)

# --- fixed values: weights, bounds and texts --------------------------------
WEIGHTS = {
    "semantic_match": 0.25,
    "skill_match": 0.30,
    "keyword_match": 0.20,
    "title_match": 0.10,
    "experience_match": 0.10,
    "education_bonus": 0.05,
}
RECOMMENDATIONS = (
    (80.0, "Strong match. Apply soon and tailor the opening summary."),
    (65.0, "Good match. Add missing priority skills before applying."),
    (45.0, "Moderate match. Customize resume bullets for this role."),
)
LOW_WITH_MISSING = "Low match. Focus on missing skills before applying."
LOW_WITHOUT_MISSING = "Low match. Review the job description before applying."
NO_DESCRIPTION = "No job description available for scoring."
NO_POSTINGS = "No jobs were available for scoring."
TRUE_FLAGS = ("1", "true", "yes", "y", "on")
BLOCKED_STATUSES = (403, 429)

# --- fixed values: marks of result cards, links and blocked pages ------------
LINK_MARKER = "/jobs/view/"
LINK_CLASS = "base-card__full-link"
ID_ATTRIBUTE = "data-job-id"
ID_IN_LINK = r"jobs/view/(\d+)"
DESCRIPTION_CLASS = "show-more-less-html__markup"
BLOCKED_MARKER = "authwall"
RESULTS_ID = "main-content"

# --- fixed values: headers of the posting and score tables -------------------
POSTING_HEADERS = {
    "position": "Serial Number",
    "job_title": "Job Title",
    "job_link": "Job Link",
    "job_description": "Job Description",
}
SCORE_HEADERS = {
    "ats_score": "ATS Score",
    "semantic_match": "Semantic Match",
    "skill_match": "Skill Match",
    "keyword_match": "Keyword Match",
    "title_match": "Title Match",
    "experience_match": "Experience Match",
    "matched_skills": "Matched Skills",
    "missing_skills": "Missing Skills",
    "recommendation": "Recommendation",
}
