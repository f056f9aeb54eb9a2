"""Reference data the operators need, kept as plain values.

Every table here is a parameter default: the operators take the table as an
argument, so a caller may pass a longer or different one.
"""

# Built-in skill names by category.
SKILL_CATEGORIES = {
    "programming": ["Python", "R", "SQL", "JavaScript", "Java", r"C\+\+", "Scala"],
    "data_tools": ["Tableau", "Power BI", "Excel", "Looker", "Metabase", "SAS", "SPSS", "Qlik"],
    "product_tools": ["Figma", "JIRA", "Confluence", "Miro", "Notion", "Asana", "Trello"],
    "analytics": ["A/B Testing", "Google Analytics", "Mixpanel", "Amplitude", "Segment", "Hotjar"],
    "ml_ai": ["Machine Learning", "NLP", "Deep Learning", "TensorFlow", "PyTorch", "Prompt Engineering", "GenAI"],
    "cloud": ["AWS", "Azure", "GCP", "Docker", "Kubernetes", "Snowflake", "Databricks"],
    "soft_skills": ["Communication", "Leadership", "Problem Solving", "Stakeholder Management", "Critical Thinking", "Collaboration"],
    "domain": ["Financial Modeling", "Market Research", "Strategy", "Operations", "Supply Chain", "User Research", "Product Roadmap"],
}

# Words never taken for a skill; short skills that are.
SKILL_BLACKLIST = ["CS", "IT", "AS", "IN", "R", "OR", "FOR", "AND", "THE", "TO", "WITH", "BY"]
SHORT_SKILLS = ["SQL", "PHP", "AWS", "C++", "GIT", "R", "SAP", "ERP", "ML", "AI", "NLP", "UX", "UI"]

# Trailing words that make a second spelling of a master skill.
SKILL_NOISE_WORDS = [
    "Programming", "Skills", "Knowledge", "Principles", "Software",
    "Tools", "Fundamentals", "Methodology", "Methodologies", "Frameworks",
]

# Location alias -> city; the first alias contained wins.
LOCATION_ALIASES = [
    ("bengaluru", "Bangalore"),
    ("bangalore", "Bangalore"),
    ("gurgaon", "Gurgaon"),
    ("gurugram", "Gurgaon"),
    ("mumbai", "Mumbai"),
    ("bombay", "Mumbai"),
    ("new delhi", "Delhi"),
    ("delhi ncr", "Delhi"),
]

# Degree label -> patterns, matched without regard to case.
EDUCATION_PATTERNS = {
    "MBA": [r"\bMBA\b", r"\bPGDM\b", r"\bMaster of Business Administration\b"],
    "B.Tech/B.E": [r"\bB\.?Tech\b", r"\bB\.?E\.?\b", r"\bBachelor of Engineering\b", r"\bBachelor of Technology\b"],
    "M.Tech/M.E": [r"\bM\.?Tech\b", r"\bM\.?E\.?\b", r"\bMaster of Engineering\b", r"\bMaster of Technology\b"],
    "Bachelor's": [r"\bBachelors?\b", r"\bDegree\b", r"\bUndergraduate\b", r"\bB\.?Sc\b", r"\bB\.?Com\b", r"\bB\.?A\b"],
    "Master's": [r"\bMasters?\b", r"\bPostgraduate\b", r"\bM\.?Sc\b", r"\bM\.?Com\b", r"\bM\.?A\b"],
    "PhD": [r"\bPhD\b", r"\bPh\.?D\b", r"\bDoctorate\b"],
}
# The two-letter degrees, which also spell the English words "be", "me", "ma".
TWO_LETTER_DEGREES = [r"\bB\.?E\.?\b", r"\bM\.?E\.?\b", r"\bB\.?A\b", r"\bM\.?A\b"]

# A requirement is met by any of these user degrees.
EDUCATION_COVERS = {
    "phd": ["phd", "doctorate"],
    "master's": ["master's", "m.tech/m.e", "mba", "postgraduate", "m.sc", "m.com", "m.a"],
    "mba": ["mba", "pgdm"],
    "b.tech/b.e": ["b.tech/b.e", "bachelor's"],
    "bachelor's": ["bachelor's", "undergraduate", "b.sc", "b.com", "b.a"],
}

# Skill synonyms, applied once.
SKILL_SYNONYMS = {
    "analytics": "analysis",
    "ai": "artificial intelligence",
    "artificial intelligence": "ai",
    "ml": "machine learning",
    "machine learning": "ml",
    "genai": "generative ai",
    "generative ai": "genai",
    "llm": "genai",
    "fullstack": "full stack",
    "frontend": "front end",
    "backend": "back end",
    "ui": "user interface",
    "ux": "user experience",
}
# One canonical spelling per swapped pair above, so that both spellings meet.
CANONICAL_SYNONYMS = {
    "analytics": "analysis",
    "ai": "artificial intelligence",
    "ml": "machine learning",
    "genai": "generative ai",
    "llm": "generative ai",
    "fullstack": "full stack",
    "frontend": "front end",
    "backend": "back end",
    "ui": "user interface",
    "ux": "user experience",
}

# Occupational clusters, label -> prototype text.
CLUSTER_DEFINITIONS = [
    ("Software Engineering – Backend & Systems", "backend java python c++ golang rust node.js api microservices distributed systems architecture server side spring boot"),
    ("Software Engineering – Frontend & Mobile", "frontend react angular vue javascript typescript android ios flutter swift mobile native web react-native redux ui development"),
    ("Full Stack & Web Development", "full stack fullstack web developer mern mean stack django flask php laravel wordpress website development html css"),
    ("Data Science & Machine Learning", "data scientist machine learning ml ai deep learning nlp pytorch tensorflow computer vision generative ai llm neural networks predictive modeling"),
    ("Data Engineering & Big Data", "data engineer etl pipeline hadoop spark kafka airflow snowflake databricks sql nosql data warehousing big data hive"),
    ("Cloud, DevOps & Platform Engineering", "devops cloud aws azure gcp kubernetes docker terraform ci/cd site reliability sre infrastructure platform engineer linux jenkins"),
    ("Cybersecurity & Information Security", "security cyber infosec penetration testing vulnerability soc siem firewall network security ethical hacking ciso"),
    ("QA, Testing & Automation", "qa quality assurance testing automation selenium cypress junit manual testing sdet test automation appium"),
    ("Product Management", "product manager pm roadmap product owner agile scrum product strategy user story feature prioritization backlog"),
    ("Project / Program Management", "project manager program manager pmp delivery manager scrum master agile coach timeline stakeholder management"),
    ("Business Analysis & Strategy", "business analyst ba strategy consultant requirements gathering process improvement use case brd frd strategic planning"),
    ("Finance & Accounting", "accountant finance tax audit ca cpa ledger financial analyst reporting budgeting reconciliation accounts payable receivable"),
    ("Investment Banking & Capital Markets", "investment banking equity research capital markets m&a valuation portfolio management trader asset management private equity venture capital"),
    ("Risk, Compliance & Governance", "risk compliance regulatory aml kyc governance internal audit legal risk fraud prevention risk management"),
    ("Sales & Business Development (B2B/B2C)", "sales business development bdm account manager inside sales presales lead generation client relation revenue growth b2b b2c"),
    ("Marketing & Growth (Digital/Brand/Performance)", "marketing digital marketing seo sem social media content strategy brand manager growth hacking campaign management google ads"),
    ("HR & Talent Management", "hr human resources recruitment talent acquisition payroll employee relations hrbp sourcing interviewing performance management"),
    ("Operations & Supply Chain", "operations supply chain logistics procurement warehouse inventory admin office manager logistics coordinator supply planning"),
    ("Legal & Corporate Secretarial", "legal lawyer advocate corporate secretary company secretary contract litigation compliance officer llb llm drafting agreements"),
    ("Design & Creative (UI/UX/Graphic/Content)", "designer graphic ui ux creative art director video editor animator content creator adobe figma photoshop illustrator"),
]

# Words of job advertisements that carry no topic.
DOMAIN_STOP_WORDS = [
    "job", "description", "role", "responsibilities", "requirements", "experience",
    "years", "skills", "key", "preferred", "qualification", "candidate", "work",
    "team", "knowledge", "strong", "ability", "good", "looking", "hiring", "company",
    "industry", "apply", "location", "salary", "benefits", "opportunity",
]

# Roles known from the start, roles of the transition table.
BASE_ROLES = [
    "product manager", "data analyst", "business analyst", "data scientist",
    "software engineer", "management consultant", "marketing manager",
    "marketing analyst", "ux designer", "ui designer", "blockchain developer",
    "full stack developer", "backend developer", "frontend developer",
    "project manager", "scrum master", "cloud architect", "devops engineer",
    "investment banker", "financial analyst", "hr manager", "sales manager",
]
MARKET_ROLES = [
    "Product Manager", "Data Scientist", "Software Engineer", "Business Analyst",
    "Marketing Manager", "HR Specialist", "Sales Manager",
]

# Cities looked for in a question, in order; always-offered locations;
# location groups of the crawl.
QUESTION_CITIES = [
    "bangalore", "mumbai", "pune", "hyderabad", "delhi", "noida",
    "gurgaon", "chennai", "remote", "kolkata", "ahmedabad",
]
COMMON_LOCATIONS = [
    "Bangalore", "Mumbai", "Pune", "Hyderabad", "Delhi",
    "Remote", "Gurgaon", "Noida", "Chennai",
]
LOCATION_GROUPS = {
    "Mumbai": ["Mumbai"],
    "Delhi": ["Delhi", "New Delhi"],
    "Pune": ["Pune"],
    "Bangalore": ["Bangalore", "Bengaluru"],
}

# Intent -> words, first group that is contained wins. The first
# table serves market questions, the second the chat.
MARKET_INTENTS = [
    ("skills", ["skill", "learn", "tech stack", "tool", "language", "requirement"]),
    ("salary", ["salary", "pay", "compensation", "earning", "ctc", "lpa", "money"]),
    ("career_path", ["career", "path", "grow", "become", "transition", "future", "guide"]),
]
CHAT_INTENTS = [
    ("skills", ["skill", "learn", "required", "stack", "tool"]),
    ("salary", ["salary", "pay", "compensation", "ctc", "earning"]),
    ("career_path", ["become", "transition", "career path", "roadmap", "grow"]),
    ("interview", ["interview", "questions", "prepare", "test"]),
]

# Patterns that name a role in a question none of the known roles fits.
ROLE_PATTERNS = [
    r"(?:for\s+a|as\s+a|become\s+a|of\s+a|to\s+be\s+a)\s+([a-z\s]+?)(?:\s+in|\s+at|\?|$|\s+role|\s+position)",
    r"([a-z\s]+?)\s+(?:jobs|role|position|career|analyst|manager|developer|engineer|consultant|specialist)",
]

# Three follow-up questions per intent; {role} is replaced.
FOLLOW_UPS = {
    "skills": [
        "What is the salary range for {role}?",
        "How do I learn these skills quickly?",
        "Show me entry-level jobs for {role}",
    ],
    "salary": [
        "What skills pay the highest for {role}?",
        "Does a Master's degree increase salary for {role}?",
        "Compare {role} salaries in Bangalore vs Mumbai",
    ],
    "career_path": [
        "What are the top certifications for {role}?",
        "What is the typical career progression after {role}?",
        "Mock interview questions for {role}",
    ],
    "interview": [
        "Give me a sample answer for a behavioral question",
        "What technical concepts should I review?",
        "How to negotiate salary for {role}",
    ],
    "general": [
        "Tell me about high-demand jobs in 2026",
        "How can I switch my career?",
        "What skills are trending right now?",
    ],
}

# Consequents too general to advise, besides the role's own words.
GENERIC_ROLE_WORDS = [
    "management", "manager", "lead", "senior", "specialist", "associate", "professional",
]

# Thresholds.
MIN_ROLE_POSTINGS = 15
MIN_LOCATION_POSTINGS = 15
FRESHNESS_DAYS = 14
PAIR_QUOTA = 50
MAX_PAGES = 20
LOW_YIELD = 3
