"""Fixed values.

Word lists, lookup tables, patterns and weights that decide results. They must be exactly
these for the scores and labels to come out right, so they are stated here in one place,
as plain text. Functions that use them take them as parameters with these defaults.
"""

# --- record constraints -----------------------------------------------------------------

ID_PATTERN = "^CAND_[0-9]{7}$"
COMPANY_SIZES = ["1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5001-10000", "10001+"]
WORK_MODES = ["remote", "hybrid", "onsite", "flexible"]
EDUCATION_TIERS = ["tier_1", "tier_2", "tier_3", "tier_4", "unknown"]
PROFICIENCIES = ["beginner", "intermediate", "advanced", "expert"]
LANGUAGE_LEVELS = ["basic", "conversational", "professional", "native"]

# --- contradiction rules ----------------------------------------------------------------

AI_SKILLS = ["pytorch", "tensorflow", "llm", "transformers", "langchain", "machine learning", "deep learning"]
TECHNICAL_TITLE_WORDS = ["engineer", "developer", "data", "science", "ml", "ai", "scientist"]
UNRELATED_SKILLS = ["nursing", "plumbing", "dentistry", "hr", "payroll", "salesforce admin"]
SENIOR_TITLE_WORDS = ["senior", "principal", "staff", "lead", "director"]

# --- honeypot rules ---------------------------------------------------------------------

TECH_RELEASE_YEARS = {
    "pytorch": 2016,
    "tensorflow": 2015,
    "kubernetes": 2014,
    "docker": 2013,
    "react": 2013,
    "langchain": 2022,
    "llamaindex": 2022,
    "chatgpt": 2022,
    "genai": 2021,
    "transformers": 2017,
}
FRONTEND_SKILLS = ["react", "angular", "vue", "css", "html", "javascript"]
BACKEND_SKILLS = ["java", "spring", "golang", "c#", "kubernetes", "docker", "backend"]
SKILL_CLUSTERS = [
    ["aws", "gcp", "azure"],
    ["pytorch", "tensorflow", "keras"],
    ["react", "angular", "vue"],
    ["postgres", "mongodb", "cassandra", "redis"],
]
AI_BUZZWORDS = ["langchain", "llamaindex", "chatgpt", "generative ai", "genai", "prompt engineering"]
AI_FOUNDATIONS = ["python", "pytorch", "tensorflow", "scikit-learn", "machine learning"]

# --- 31-column feature set (whole-name matches) -------------------------------------------

PRODUCTION_SKILLS = ["docker", "kubernetes", "mlops"]
VECTOR_DB_SKILLS = ["pinecone", "weaviate", "milvus", "qdrant", "faiss"]
RETRIEVAL_SKILLS = ["bm25", "elasticsearch", "solr", "retrieval"]
RANKING_SKILLS = ["ranking", "learning to rank", "xgboost", "lightgbm"]
LLM_SKILLS = ["llm", "gpt", "langchain", "llamaindex", "huggingface"]
FINE_TUNING_SKILLS = ["lora", "qlora", "fine-tuning", "peft"]
SENIORITY_POINTS = {"intern": 0, "junior": 1, "mid": 2, "senior": 3, "lead": 4, "principal": 5}

# --- 26-column feature set (substring matches) --------------------------------------------

VECTOR_DB_FRAGMENTS = ["pinecone", "weaviate", "milvus", "qdrant", "chroma"]
RETRIEVAL_FRAGMENTS = ["rag", "retrieval", "search", "elasticsearch"]
RANKING_FRAGMENTS = ["ranking", "learning to rank", "lambdamart", "xgboost", "lightgbm"]
LLM_FRAGMENTS = ["llm", "gpt", "llama", "transformers", "huggingface"]
FINE_TUNING_FRAGMENTS = ["fine-tuning", "lora", "qlora", "peft"]
KNOWN_COMPANIES = ["google", "meta", "amazon", "microsoft", "apple", "netflix"]

# --- scoring ----------------------------------------------------------------------------

PROFICIENCY_POINTS = {"expert": 4, "advanced": 3, "intermediate": 2, "beginner": 1}
LABEL_REASONS = {
    "fraud": "Bad Fit: Non-technical, contradictory, or impossible profile",
    "excellent": "Excellent Fit: Meets all exact required ML/Retrieval criteria",
    "good": "Good Fit: Missing some core skills but has solid ML foundations",
    "weak": "Weak Fit: Adjacent technical profile lacking specific ML/Retrieval experience",
    "none": "Bad Fit: Lacks technical alignment",
}
DEFAULT_REASONING = "Strong semantic match."
RANKING_HEADER = ["candidate_id", "rank", "score", "reasoning"]
NON_FEATURE_COLUMNS = [
    "candidate_id", "label", "reason", "hybrid_score", "points", "contradiction_score", "honeypot_score",
]

# --- job description: sections and sentence cues --------------------------------------------

SECTION_HEADERS = {
    "requirements": [
        "requirements", "required", "must have", "must-have", "what you need", "what we need", "you must",
        "what you'll need", "minimum qualifications", "basic qualifications", "mandatory", "essential",
    ],
    "preferred": [
        "preferred", "nice to have", "nice-to-have", "bonus", "good to have", "good-to-have", "plus",
        "additional", "preferred qualifications", "desired", "ideally", "would be great",
    ],
    "responsibilities": [
        "responsibilities", "what you'll do", "what you will do", "role & responsibilities",
        "key responsibilities", "your role", "the job", "about the role", "duties",
    ],
    "about_company": [
        "about us", "about the company", "who we are", "our story", "company overview", "at [company]",
    ],
    "perks": ["perks", "benefits", "what we offer", "compensation", "why join", "what's in it for you"],
}
MUST_HAVE_CUES = [
    "required", "must have", "must-have", "mandatory", "essential", "you must", "need to have",
    "need to know", "is required", "are required", "experience with", "proficiency in",
    "strong experience", "proven experience", "hands-on experience", "solid understanding",
    "deep understanding", "expertise in", "background in", "demonstrated experience", "minimum",
]
NICE_TO_HAVE_CUES = [
    "preferred", "nice to have", "nice-to-have", "bonus", "plus", "good to have", "ideal", "ideally",
    "familiarity with", "exposure to", "knowledge of", "experience with would be", "would be great",
    "advantageous", "desirable", "a plus", "not required", "optional",
]
NEGATION_CUES = [
    "no experience required", "not required", "no prior", "without", "regardless of",
    "even if you don't", "don't need",
]

# --- job description: skills -------------------------------------------------------------
# Skill name, then the other spellings it is known by. The lower-cased name is a spelling too.

SKILL_SPELLINGS = {
    "Python": [],
    "JavaScript": ["js"],
    "TypeScript": ["ts"],
    "Java": [],
    "Go": ["golang", "go lang"],
    "Rust": [],
    "C++": ["c plus plus", "cpp"],
    "C#": ["c sharp", "csharp"],
    "Scala": [],
    "R": ["r language", "r programming"],
    "SQL": ["structured query language"],
    "Bash": ["shell scripting", "bash scripting"],
    "PyTorch": ["torch"],
    "TensorFlow": ["tf"],
    "Keras": [],
    "scikit-learn": ["sklearn", "scikit learn"],
    "XGBoost": ["xgb"],
    "LightGBM": ["lgbm"],
    "CatBoost": [],
    "JAX": [],
    "Hugging Face": ["huggingface", "hf transformers"],
    "ONNX": [],
    "LLM": ["large language model", "large language models"],
    "GPT": ["gpt-4", "gpt4", "gpt-3.5", "chatgpt"],
    "BERT": ["roberta", "distilbert", "albert"],
    "Fine-tuning": ["fine tuning", "finetuning", "lora", "qlora", "peft"],
    "RAG": ["retrieval augmented generation", "retrieval-augmented"],
    "LangChain": ["lang chain"],
    "LlamaIndex": ["llama index", "llama-index"],
    "Prompt Engineering": ["prompting", "prompt design"],
    "Embeddings": ["word embeddings", "sentence embeddings", "text embeddings"],
    "Generative AI": ["gen ai", "genai"],
    "Stable Diffusion": [],
    "OpenAI API": ["openai"],
    "Anthropic": ["claude api"],
    "NLP": ["natural language processing", "natural-language processing"],
    "Text Mining": ["text analysis", "information extraction"],
    "Named Entity Recognition": ["ner"],
    "Sentiment Analysis": ["opinion mining"],
    "Speech Recognition": ["asr", "automatic speech recognition"],
    "TTS": ["text to speech", "text-to-speech"],
    "Computer Vision": ["cv"],
    "OpenCV": [],
    "Image Classification": [],
    "Object Detection": ["yolo", "yolov5", "yolov8"],
    "Image Segmentation": ["semantic segmentation"],
    "CNNs": ["cnn", "convolutional neural network", "convolutional"],
    "MLflow": [],
    "MLOps": ["ml ops"],
    "Kubeflow": [],
    "Airflow": [],
    "DVC": ["data version control"],
    "Weights & Biases": ["wandb", "w&b"],
    "Docker": ["containerization", "containers"],
    "Kubernetes": ["k8s"],
    "CI/CD": ["cicd", "continuous integration", "continuous deployment", "jenkins", "github actions"],
    "AWS": ["amazon web services", "sagemaker", "aws sagemaker", "ec2", "s3", "lambda"],
    "GCP": ["google cloud", "vertex ai", "gcp vertex"],
    "Azure": ["microsoft azure", "azure ml", "azure openai"],
    "Spark": ["apache spark", "pyspark"],
    "Kafka": ["apache kafka"],
    "Flink": ["apache flink"],
    "dbt": ["data build tool"],
    "Snowflake": [],
    "Databricks": [],
    "DuckDB": [],
    "Redshift": ["amazon redshift"],
    "BigQuery": ["bq"],
    "PostgreSQL": ["postgres"],
    "MySQL": [],
    "Redis": [],
    "MongoDB": ["mongo"],
    "Elasticsearch": ["elastic search"],
    "Pinecone": [],
    "Weaviate": [],
    "Chroma": ["chromadb", "chroma db"],
    "Milvus": [],
    "FAISS": [],
    "FastAPI": ["fast api"],
    "Flask": [],
    "Django": [],
    "React": ["reactjs", "react.js"],
    "Node.js": ["nodejs", "node js"],
    "Next.js": ["nextjs"],
    "Statistical Modeling": ["statistical modelling", "statistics"],
    "A/B Testing": ["ab testing", "experimentation"],
    "Feature Engineering": [],
    "SHAP": ["shapley"],
    "Bayesian Methods": ["bayesian", "bayesian statistics", "bayesian inference"],
    "Time Series": ["forecasting", "arima", "prophet"],
    "Reinforcement Learning": ["rl", "deep rl", "deep reinforcement"],
    "Git": ["github", "gitlab", "bitbucket", "version control"],
    "REST API": ["rest", "restful", "api design"],
    "GraphQL": [],
    "Linux": ["unix"],
    "Terraform": ["infrastructure as code", "iac"],
    "NumPy": [],
    "Pandas": [],
    "Matplotlib": ["seaborn", "plotly", "visualization"],
    "Jupyter": ["jupyter notebook", "jupyterlab"],
}
#: Lower-cased names that rank behind all other spellings of the same length.
SPELLED_LAST = ["go", "r", "cnns", "chroma", "bayesian methods"]
#: The pattern of a capital R standing alone; its own length places it among the spellings.
LONE_R = r"\br\b"
PRODUCTION_ML_SKILLS = ["docker", "kubernetes", "mlops", "mlflow", "deployment", "aws", "gcp", "azure", "production"]

# --- job description: industries and places -------------------------------------------------

INDUSTRY_WORDS = {
    "FinTech / Finance": [
        "fintech", "financial services", "banking", "payments", "trading", "hedge fund", "investment bank",
        "insurance",
    ],
    "HealthTech / Healthcare": [
        "healthtech", "health tech", "healthcare", "medical", "pharma", "biotech", "clinical",
    ],
    "EdTech / Education": ["edtech", "ed tech", "education", "e-learning", "lms"],
    "E-Commerce / Retail": ["e-commerce", "ecommerce", "retail", "marketplace", "shopify"],
    "SaaS / Software": ["saas", "software as a service", "software company", "b2b software"],
    "Cybersecurity": ["cybersecurity", "cyber security", "infosec", "security"],
    "Logistics / Supply Chain": ["logistics", "supply chain", "transportation", "fleet"],
    "Gaming": ["gaming", "game development", "game studio"],
    "Media / Entertainment": ["media", "entertainment", "streaming", "content"],
    "Automotive": ["automotive", "ev", "electric vehicle", "autonomous vehicles"],
    "Manufacturing / Industry": ["manufacturing", "industrial", "iot", "robotics"],
    "Consulting": ["consulting", "management consulting", "advisory"],
    "IT Services": ["it services", "outsourcing", "bpo", "managed services"],
    "Agriculture / AgriTech": ["agriculture", "agritech", "agri-tech", "farming"],
    "Real Estate / PropTech": ["real estate", "proptech", "prop-tech"],
}
CITIES = {  # spelling: (city, country); the first spelling found wins
    "bangalore": ("Bangalore", "India"),
    "bengaluru": ("Bangalore", "India"),
    "mumbai": ("Mumbai", "India"),
    "delhi": ("Delhi", "India"),
    "new delhi": ("New Delhi", "India"),
    "hyderabad": ("Hyderabad", "India"),
    "chennai": ("Chennai", "India"),
    "pune": ("Pune", "India"),
    "gurgaon": ("Gurgaon", "India"),
    "gurugram": ("Gurgaon", "India"),
    "noida": ("Noida", "India"),
    "kolkata": ("Kolkata", "India"),
    "ahmedabad": ("Ahmedabad", "India"),
    "san francisco": ("San Francisco", "USA"),
    "new york": ("New York", "USA"),
    "seattle": ("Seattle", "USA"),
    "austin": ("Austin", "USA"),
    "boston": ("Boston", "USA"),
    "london": ("London", "UK"),
    "berlin": ("Berlin", "Germany"),
    "singapore": ("Singapore", "Singapore"),
    "toronto": ("Toronto", "Canada"),
    "sydney": ("Sydney", "Australia"),
    "dubai": ("Dubai", "UAE"),
}
COUNTRIES = {
    "india": "India",
    "usa": "USA",
    "united states": "USA",
    "us": "USA",
    "uk": "UK",
    "united kingdom": "UK",
    "canada": "Canada",
    "australia": "Australia",
    "germany": "Germany",
    "singapore": "Singapore",
}
WORK_MODE_PHRASES = {  # in order of priority
    "hybrid": ["hybrid"],
    "onsite": [
        "on-site", "onsite", "in-office", "in office", "full-time in office", "office only",
        "in office only", "no remote", "no work from home",
    ],
    "remote": ["remote", "work from home", "wfh", "fully remote", "100% remote"],
    "flexible": ["flexible", "flexible work"],
}
RELOCATION_PHRASES = [
    "relocation assistance", "relocation support", "relocation package", "we cover relocation",
]
VISA_PHRASES = ["visa sponsorship", "we sponsor", "work authorization", "h1b", "h-1b"]

# --- job description: seniority ----------------------------------------------------------

SENIORITY_PHRASES = [  # (level, confidence, phrases); a later level wins only with higher confidence
    ("intern", 0.95, ["intern", "internship", "apprentice", "trainee"]),
    ("junior", 0.85, [
        "junior", "entry level", "entry-level", "associate", "0-2 years", "0 to 2 years", "fresher",
    ]),
    ("mid", 0.80, ["mid level", "mid-level", "2-5 years", "2 to 5 years", "mid-senior", "3-5 years"]),
    ("senior", 0.90, [
        "senior", "sr.", "sr ", "5+ years", "5-8 years", "5 to 8 years", "7+ years", "experienced",
    ]),
    ("lead", 0.90, ["lead", "tech lead", "team lead", "technical lead", "engineering lead", "squad lead"]),
    ("principal", 0.90, ["principal", "staff engineer", "distinguished", "10+ years", "10 to 15 years"]),
    ("staff", 0.85, ["staff engineer", "staff ml", "staff data scientist"]),
    ("director", 0.92, [
        "director", "head of engineering", "head of ai", "head of data", "head of product",
        "vp of engineering", "vp engineering",
    ]),
    ("vp", 0.95, ["vice president", "svp", "evp"]),
    ("executive", 0.95, [
        "cto", "chief technology officer", "ceo", "coo", "chief data officer", "c-suite",
    ]),
]
SENIORITY_YEARS = {
    "intern": (0, 1),
    "junior": (0, 3),
    "mid": (2, 6),
    "senior": (4, 10),
    "lead": (6, 14),
    "principal": (8, 25),
    "staff": (8, 25),
    "director": (10, 30),
    "vp": (12, 30),
    "executive": (15, 40),
}
INFERRED_SENIORITY = [  # (years up to, level, confidence); beyond the last: principal
    (0, "intern", 0.55),
    (2, "junior", 0.60),
    (5, "mid", 0.60),
    (8, "senior", 0.60),
    (12, "lead", 0.55),
    (None, "principal", 0.55),
]
SENIOR_LEVELS = ["senior", "lead", "principal", "staff", "director", "vp", "executive"]

# --- job description: startup, leadership and negative signals ---------------------------------

STARTUP_PHRASES = {  # phrase: (flag it sets, funding stage it names)
    "seed": ("is_startup", "seed"),
    "series a": ("is_startup", "series_a"),
    "series b": ("is_startup", "series_b"),
    "series c": ("is_startup", "series_c"),
    "series d": ("is_startup", "series_d"),
    "growth stage": ("is_startup", "growth"),
    "pre-ipo": ("is_startup", "pre_ipo"),
    "vc-backed": ("is_startup", None),
    "venture-backed": ("is_startup", None),
    "funded startup": ("is_startup", None),
    "fast-paced": ("fast_paced", None),
    "fast paced": ("fast_paced", None),
    "move fast": ("fast_paced", None),
    "rapidly growing": ("fast_paced", None),
    "high-growth": ("fast_paced", None),
    "high growth": ("fast_paced", None),
    "high ownership": ("ownership_culture", None),
    "high-ownership": ("ownership_culture", None),
    "own your work": ("ownership_culture", None),
    "take ownership": ("ownership_culture", None),
    "bias for action": ("ownership_culture", None),
    "strong sense of ownership": ("ownership_culture", None),
    "scrappy": ("scrappy_culture", None),
    "wear many hats": ("scrappy_culture", None),
    "generalist": ("scrappy_culture", None),
    "flat structure": ("flat_hierarchy", None),
    "flat hierarchy": ("flat_hierarchy", None),
    "no bureaucracy": ("flat_hierarchy", None),
    "equity": ("equity_mentioned", None),
    "esop": ("equity_mentioned", None),
    "stock options": ("equity_mentioned", None),
    "vesting": ("equity_mentioned", None),
    "startup": ("is_startup", None),
    "early stage": ("is_startup", None),
    "early-stage": ("is_startup", None),
    "seed-funded": ("is_startup", None),
}
LEADERSHIP_PATTERNS = [
    (r"manage\s+a\s+team", "requires_management"),
    (r"manage\s+\d+\s*(?:engineers?|data scientists?|people|reports?)", "requires_management"),
    (r"people\s+manager", "requires_management"),
    (r"people\s+management", "requires_management"),
    (r"(\d+)\s*(?:to|-)\s*(\d+)\s*(?:direct)?\s*reports?", "reports_range"),
    (r"team\s+of\s+(\d+)\s*(?:to|-)\s*(\d+)", "reports_range"),
    (r"team\s+of\s+(\d+)\+?", "min_reports"),
    (r"(\d+)\+?\s*(?:direct)?\s*reports?", "min_reports"),
    (r"lead\s+(?:and\s+)?(?:grow|build|scale|develop|mentor)\s+(?:a\s+)?(?:team|engineers?|scientists?)",
     "requires_management"),
    (r"build\s+(?:out\s+)?(?:and\s+)?(?:lead|grow|scale)\s+(?:a\s+)?team", "requires_management"),
    (r"grow\s+the\s+team", "hiring_manager"),
    (r"hire\s+(?:and\s+develop)?|hiring\s+(?:and\s+developing)?|build\s+the\s+team", "hiring_manager"),
    (r"cross[\s-]functional", "cross_functional"),
    (r"work\s+(?:closely\s+)?with\s+(?:product|design|sales|marketing|business)\s+teams?", "cross_functional"),
    (r"define\s+(?:the\s+)?(?:technical\s+)?(?:vision|roadmap|strategy|direction)", "strategy_ownership"),
    (r"technical\s+(?:vision|roadmap|strategy|direction)", "strategy_ownership"),
    (r"drive\s+(?:the\s+)?(?:technical|engineering)\s+(?:vision|roadmap|strategy)", "strategy_ownership"),
    (r"tech(?:nical)?\s+lead(?:ership)?(?:\s+of\s+(?:the\s+)?team)?", "technical_lead"),
    (r"lead\s+(?:the\s+)?(?:technical|engineering|architecture)\s+(?:decisions?|work|direction)", "technical_lead"),
    (r"mentor(?:ing)?\s+(?:junior|mid[\s-]level|other)?\s*(?:engineers?|developers?|scientists?)", "technical_lead"),
]
NEGATIVE_PATTERNS = [  # (pattern, category, label)
    (r"freshers?\s+(?:only|preferred)|only\s+freshers?", "seniority_cap", "Freshers only"),
    (r"no\s+(?:prior\s+)?(?:llm|ai|ml|machine\s+learning)\s+experience\s+(?:required|necessary|needed)",
     "skill_exclusion", "No ML experience required"),
    (r"non[\s-]technical\s+background", "culture_mismatch", "Non-technical background preferred"),
    (r"no\s+remote|in[\s-]office\s+only|onsite\s+only|no\s+work\s+from\s+home", "availability", "No remote work"),
    (r"immediate\s+(?:joiner|joining)|join\s+immediately|joining\s+immediately",
     "availability", "Immediate joiner required"),
    (r"must\s+be\s+(?:based\s+)?(?:in|at)\s+(?:[A-Z][a-z]+(?:\s[A-Z][a-z]+)*)",
     "availability", "Must be in specific location"),
    (r"(?:no|without)\s+(?:gaps?|career\s+gaps?)\s+(?:in\s+)?(?:employment|resume|cv)",
     "culture_mismatch", "No employment gaps"),
    (r"not\s+looking\s+for\s+(?:freshers?|entry[\s-]level|juniors?)", "seniority_cap", "Not for entry-level"),
    (r"(?:no|not)\s+(?:open|available|accepting)\s+(?:to\s+)?(?:remote|wfh|work\s+from\s+home)",
     "availability", "No remote candidates"),
    (r"notice\s+period\s+(?:of\s+)?(?:0|zero|immediate|15\s+days?)\s+(?:only|or\s+less)",
     "availability", "Short notice period required"),
]

# --- job description: experience, salary and titles -------------------------------------------

EXPERIENCE_PATTERNS = [
    r"(\d+(?:\.\d+)?)\s*[-–to]+\s*(\d+(?:\.\d+)?)\s*(?:years?|yrs?)\b",
    r"(?:minimum|min(?:imum)?|at\s?least|minimum\s+of)\s+(\d+(?:\.\d+)?)\+?\s*(?:years?|yrs?)\b",
    r"(\d+(?:\.\d+)?)\+\s*(?:years?|yrs?)\b",
    r"(\d+(?:\.\d+)?)\s*(?:years?|yrs?)\s*(?:of\s+)?(?:relevant\s+)?(?:experience|exp)\b",
    r"experience\s+of\s+(\d+(?:\.\d+)?)\+?\s*(?:years?|yrs?)\b",
]
SALARY_PATTERNS = [
    r"(?:₹|INR|Rs\.?)\s*(\d+(?:\.\d+)?)\s*[-–to]+\s*(\d+(?:\.\d+)?)\s*(?:LPA|lpa|lakhs?)\b",
    r"(\d+(?:\.\d+)?)\s*[-–to]+\s*(\d+(?:\.\d+)?)\s*(?:LPA|lpa|lakhs?)\b",
    r"(?:₹|INR|Rs\.?)\s*(\d+(?:\.\d+)?)\s*(?:LPA|lpa|lakhs?)\b",
]
TITLE_LINE_WORDS = [
    "engineer", "scientist", "analyst", "manager", "developer", "lead", "architect", "researcher", "specialist",
]
HIRING_PATTERN = r"(?:hiring|looking for|seeking|recruiting)\s+(?:a|an)\s+([A-Z][a-zA-Z\s/,]+?)(?:[.,!?]|\s{2}|$)"
ROLE_PATTERN = r"(?:role|position|title|job title)\s*:\s*([A-Z][a-zA-Z\s/,\-]+?)(?:\n|$)"
KNOWN_TITLES = [
    "Machine Learning Engineer", "ML Engineer", "Senior ML Engineer", "Data Scientist",
    "Senior Data Scientist", "Staff Data Scientist", "AI Engineer", "Applied Scientist",
    "Research Scientist", "NLP Engineer", "Computer Vision Engineer", "MLOps Engineer", "Data Engineer",
    "Analytics Engineer", "AI Researcher", "Deep Learning Engineer", "Software Engineer",
    "Backend Engineer", "Full Stack Engineer", "Head of AI", "Director of Engineering",
    "VP of Engineering", "Principal Engineer", "Staff Engineer",
]
