"""Texts of the golden cases and the values they must give, computed by hand."""

RESUME = """
Data platform engineer, 7 years with Linux, Kubernetes, Docker and PostgreSQL.
Airflow pipelines in Python, GraphQL services, Git reviews, Jira boards.
Holds a master degree.
"""
STRONG = """
    We look for a data platform engineer: 3+ years of experience with Airflow,
    Docker, Kubernetes, Linux, PostgreSQL, GraphQL, Git and Python.
"""
WEAK = """
    Pastry chef wanted for early shifts: sourdough, croissants, stock orders
    and a calm team in a small bakery.
"""
MISSING = """
    Data platform engineer who knows Python, Airflow and Linux, plus Azure,
    Cypress, MongoDB and TypeScript.
"""
ROW = "Data engineer for PostgreSQL, Python, Docker and Airflow on Linux; 5+ years of experience."
PLAIN_JOB = """
    Garden keeper for a public park: planting, pruning, paths and tools;
    talks with visitors.
"""
PLAIN_RESUME = """
    Worked in a garden centre, planted beds and looked after tools.
"""
EIGHT = "Linux administrator, 8 years with Docker and Python."
TWO_ASKED = "Linux role, 2 years with Docker and Python asked."
TWO = "Linux administrator, 2 years with Docker and Python."
SEVEN_ASKED = "Linux role, 7 years with Docker and Python asked."

# name, resume, description, title, matched, missing, skill, title, experience, education
CASES = [
    ("strong", RESUME, STRONG, "Data Platform Engineer",
     "airflow, docker, git, graphql, kubernetes, linux, postgresql, python, sql", "",
     100.0, 100.0, 100.0, 100.0),
    ("weak", RESUME, WEAK, "Pastry Chef", "", "", 0.0, 0.0, 100.0, 100.0),
    ("missing", RESUME, MISSING, "Data Platform Engineer", "airflow, linux, python",
     "azure, cypress, mongodb, typescript", 42.86, 100.0, 100.0, 100.0),
    ("row", RESUME, ROW, "Data Platform Engineer",
     "airflow, docker, linux, postgresql, python, sql", "", 100.0, 100.0, 100.0, 100.0),
    ("plain", PLAIN_RESUME, PLAIN_JOB, "Garden Keeper", "", "", 0.0, 50.0, 100.0, 100.0),
    ("over", EIGHT, TWO_ASKED, "Linux Administrator", "docker, linux, python", "", 100.0, 100.0, 100.0, 100.0),
    ("under", TWO, SEVEN_ASKED, "Linux Administrator", "docker, linux, python", "", 100.0, 100.0, 28.57, 100.0),
    ("empty", RESUME, "", "Data Engineer", "", "", 0.0, 0.0, 0.0, 0.0),
]
