"""Skill vocabulary and the word lists the text rules depend on.

Everything in the upper half is a fixed value: results only come out right
if these lists are exactly these.  The lower half derives lookup structures from
them by rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

# ---------------------------------------------------------------------------
# Skill vocabulary.  slug | label | category | other spellings
# ---------------------------------------------------------------------------
SKILL_TABLE = """
java | Java | language | java8, java 8, java11, core java
python | Python | language | python3, py
javascript | JavaScript | language | js, es6, ecmascript
typescript | TypeScript | language | ts
go | Go | language | golang
rust | Rust | language |
c | C | language |
cpp | C++ | language | c++, cplusplus
csharp | C# | language | c#, c sharp, dotnet c#
ruby | Ruby | language |
php | PHP | language |
scala | Scala | language |
kotlin | Kotlin | language |
swift | Swift | language |
objective-c | Objective-C | language | objc
sql | SQL | language | t-sql, pl/sql, plsql
bash | Bash | language | shell, shell scripting, sh
r | R | language |
perl | Perl | language |
elixir | Elixir | language |
clojure | Clojure | language |
haskell | Haskell | language |
dart | Dart | language |
lua | Lua | language |
solidity | Solidity | language |
spring | Spring | framework | spring framework
spring-boot | Spring Boot | framework | springboot, spring.boot
hibernate | Hibernate | framework | jpa
node | Node.js | framework | nodejs, node js, node.js
express | Express | framework | expressjs, express.js
nestjs | NestJS | framework | nest.js, nest
react | React | framework | reactjs, react.js
nextjs | Next.js | framework | next.js, next js
vue | Vue | framework | vuejs, vue.js
angular | Angular | framework | angularjs, angular.js
svelte | Svelte | framework | sveltekit
django | Django | framework |
flask | Flask | framework |
fastapi | FastAPI | framework |
rails | Ruby on Rails | framework | ruby on rails, ror
laravel | Laravel | framework |
dotnet | .NET | framework | .net, asp.net, aspnet, dot net
react-native | React Native | framework | react-native
flutter | Flutter | framework |
tailwind | Tailwind CSS | framework | tailwindcss
graphql | GraphQL | framework |
grpc | gRPC | framework |
rest | REST | framework | restful, rest api, restful api, rest apis
postgresql | PostgreSQL | datastore | postgres, psql, postgre sql
mysql | MySQL | datastore | my sql
oracle | Oracle | datastore | oracle db, oracle database
sqlserver | SQL Server | datastore | mssql, microsoft sql server
sqlite | SQLite | datastore |
mongodb | MongoDB | datastore | mongo
redis | Redis | datastore |
cassandra | Cassandra | datastore |
dynamodb | DynamoDB | datastore | dynamo
elasticsearch | Elasticsearch | datastore | elastic search, opensearch
kafka | Kafka | datastore | apache kafka, event streaming
rabbitmq | RabbitMQ | datastore | rabbit mq, amqp
snowflake | Snowflake | datastore |
bigquery | BigQuery | datastore | big query
clickhouse | ClickHouse | datastore |
neo4j | Neo4j | datastore |
aws | AWS | cloud | amazon web services
azure | Azure | cloud | microsoft azure
gcp | GCP | cloud | google cloud, google cloud platform
docker | Docker | cloud | containers, containerisation, containerization
kubernetes | Kubernetes | cloud | k8s, eks, gke, aks
terraform | Terraform | cloud | hcl
ansible | Ansible | cloud |
helm | Helm | cloud |
jenkins | Jenkins | cloud |
github-actions | GitHub Actions | cloud | gh actions
gitlab-ci | GitLab CI | cloud | gitlab ci/cd
prometheus | Prometheus | cloud |
grafana | Grafana | cloud |
datadog | Datadog | cloud | data dog
nginx | Nginx | cloud |
kong | Kong | cloud |
serverless | Serverless | cloud | lambda, aws lambda, cloud functions
linux | Linux | cloud | unix
distributed-systems | Distributed systems | practice | distributed system
microservices | Microservices | practice | microservice, micro services
api-design | API design | practice | api development, api architecture
system-design | System design | practice | systems design
testing | Testing | practice | unit testing, automated testing, tdd, bdd
ci-cd | CI/CD | practice | ci/cd, cicd, continuous integration, continuous delivery
agile | Agile | practice | scrum, kanban
code-review | Code review | practice |
observability | Observability | practice | monitoring, telemetry
performance | Performance engineering | practice | performance tuning, optimisation
security | Security | practice | appsec, application security
sre | SRE | practice | site reliability, sre practices, reliability engineering
event-driven | Event-driven architecture | practice | eda, event driven
caching | Caching | practice |
data-modelling | Data modelling | practice | data modeling, schema design
machine-learning | Machine learning | practice | ml, deep learning
mlops | MLOps | practice |
etl | ETL | practice | elt, data pipelines
payments | Payments | domain | payment systems, payment processing, payment gateway
ledgers | Ledgers | domain | ledger, double entry, general ledger
settlement | Settlement | domain | reconciliation, settlements
card-networks | Card networks | domain | visa, mastercard, card processing
pci | PCI compliance | domain | pci-dss, pci dss
fintech | Fintech | domain | financial services, banking
lending | Lending | domain | credit, underwriting
fraud | Fraud detection | domain | risk, aml, kyc
ecommerce | E-commerce | domain | e-commerce, commerce
healthcare | Healthcare | domain | healthtech
gaming | Gaming | domain | games
adtech | Adtech | domain | advertising
identity | Identity | domain | iam, authentication, authorization, oauth, sso
git | Git | tool | github, gitlab, version control
jira | Jira | tool |
maven | Maven | tool |
gradle | Gradle | tool |
webpack | Webpack | tool |
vite | Vite | tool |
tomcat | Tomcat | tool | apache tomcat, apachetomcat
weblogic | WebLogic | tool |
kibana | Kibana | tool |
airflow | Airflow | tool | apache airflow
spark | Spark | tool | apache spark, pyspark
hadoop | Hadoop | tool |
pandas | pandas | tool |
numpy | NumPy | tool |
pytorch | PyTorch | tool |
tensorflow | TensorFlow | tool |
"""

# Names that are also ordinary words and need supporting context.
AMBIGUOUS_SLUGS = (
    "go", "c", "r", "rust", "swift", "dart", "spark", "kong", "agile",
    "performance", "security", "testing", "identity", "caching",
)

# Words that follow the verb, never the technology.
VERB_CONTINUATIONS = (
    "beyond", "through", "to", "into", "above", "live", "back", "ahead",
    "forward", "out", "up", "down", "over", "past", "along", "well", "the",
    "extra", "wrong", "right", "public", "deep", "hand", "unnoticed",
)

# Words that introduce a technology directly in front of it.
ADJACENT_CUES = ("in", "with", "using", "know", "knows", "written", "write", "writing", "learn")

# Words that introduce a technology from a few characters away (patterns).
STRONG_CUES = (
    "experience", r"proficien\w*", "fluent", "expertise", "skilled", r"familiar\w*", "hands-on",
)

# Nouns that only follow a technology (patterns).
TECH_NOUNS = (
    "developer", "engineer", "programming", "language", "codebase", "services?",
    "microservices?", "backend", "lang", "experience", "expertise", "skills?",
    "knowledge", "background", "development",
)

# Phrases marking what follows as required / as preferred.
REQUIRED_CUES = (
    "required", "requirements", "must have", "must-have", "you have",
    "you will need", "essential", "minimum qualifications", "what you bring",
    "qualifications", "we require", "proficiency in", "strong experience", "expert in",
)
PREFERRED_CUES = (
    "nice to have", "nice-to-have", "preferred", "bonus", "plus", "a plus",
    "desirable", "advantageous", "would be great", "ideally", "familiarity with",
    "exposure to",
)

# Search-term words that carry no meaning / only a level.
STOPWORDS = ("a", "an", "the", "and", "or", "of", "for", "in", "at", "to")
SENIORITY_WORDS = (
    "senior", "sr", "junior", "jr", "lead", "staff", "principal", "mid",
    "entry", "level", "i", "ii", "iii", "iv",
)

# Legal suffixes ignored when company names are compared.
COMPANY_SUFFIXES = (
    "inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation",
    "gmbh", "bv", "plc", "pvt", "private", "technologies", "technology",
    "labs", "group", "holdings",
)
COMPANY_KEY_EXTRA_SUFFIXES = ("india", "global")

# How much a held skill counts, in hundredths, by level.
LEVEL_POINTS = {"exposure": 55, "working": 80, "strong": 100, "expert": 100}
CATEGORIES = (
    "language", "framework", "datastore", "cloud", "practice", "domain", "tool", "other",
)

# ---------------------------------------------------------------------------
# Derived lookups
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Skill:
    slug: str
    label: str
    category: str
    aliases: tuple[str, ...]

    def spellings(self) -> list[str]:
        """Label and aliases, plus the slug when it reads like prose (no hyphen)."""
        out = [self.label.lower(), *self.aliases]
        if "-" not in self.slug:
            out.append(self.slug)
        return list(dict.fromkeys(out))


@dataclass(frozen=True)
class Term:
    """One spelling worth scanning for; ``rank`` is the global scan order."""

    term: str
    slug: str
    rank: int
    ambiguous: bool


@lru_cache(maxsize=1)
def skills() -> tuple[Skill, ...]:
    rows = []
    for line in SKILL_TABLE.strip().splitlines():
        slug, label, category, aliases = (part.strip() for part in line.split("|"))
        rows.append(Skill(slug, label, category, tuple(a.strip() for a in aliases.split(",") if a.strip())))
    return tuple(rows)


@lru_cache(maxsize=1)
def by_slug() -> dict[str, Skill]:
    return {s.slug: s for s in skills()}


@lru_cache(maxsize=1)
def alias_to_slug() -> dict[str, str]:
    table: dict[str, str] = {}
    for s in skills():
        for spelling in (s.slug, s.label.lower(), *(a.lower() for a in s.aliases)):
            table[spelling] = s.slug
    return table


def plain(text: str) -> str:
    """Driver-side twin of ``functions.text.normalise_skill_text`` for vocabulary entries."""
    lowered = re.sub(r"[（(\[{].*?[）)\]}]", " ", text.lower())
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9+#./\s-]", " ", lowered)).strip()


@lru_cache(maxsize=1)
def search_terms() -> tuple[Term, ...]:
    """Every spelling of at least two characters, longest first, otherwise in table order."""
    pairs = [(plain(sp), s.slug) for s in skills() for sp in s.spellings()]
    pairs = sorted((p for p in pairs if len(p[0]) >= 2), key=lambda p: -len(p[0]))
    return tuple(
        Term(term, slug, rank, slug in AMBIGUOUS_SLUGS and term == slug)
        for rank, (term, slug) in enumerate(pairs)
    )
