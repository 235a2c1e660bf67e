"""Job descriptions written for the golden tests."""

SENIOR_ML = """
Senior Ranking Engineer — Pune (Hybrid)

About Us
Shops rent our search boxes. We are a startup that closed its Series B in May,
a fast-paced place of high ownership where all hold equity.

Requirements
- 6-9 years spent on ranking or retrieval
- Python every day, PyTorch most days
- LLM fine-tuning, with LoRA or without
- One RAG system in production, on Pinecone or FAISS
- Docker images that others can run, Kubernetes to run them on
- SQL is required

Preferred
- A look into LangChain or LlamaIndex
- Weights & Biases for keeping track of runs
- MLflow
- Rust, if only for fun

Responsibilities
- Lead a team of 3-5 engineers
- Own the technical roadmap of the ranking service
- Mentor whoever joins
- Work cross-functionally with the shop owners

Compensation
- 35-70 LPA and stock
"""

JUNIOR_DATA = """
Junior Data Analyst (first job welcome)
Chennai

The numbers team has grown and wants a Junior Data Analyst.

What you need:
• 0-1 years with tables of any kind
• Python, some pandas
• SQL that returns the right rows

Good to have:
• TensorFlow or PyTorch, from a course
• Tableau

What you get:
• A desk: no remote, in-office only
"""

DIRECTOR = """
Director of Data Platforms

Thirty people run our pipelines; they want a Director.

Requirements:
- 14+ years in data
- Manage a team of 6-9 leads
- Hire and develop the next ones
- Set the technical vision and strategy
- Cross-functional talks with sales and law

Must have: Python, AWS
Preferred: Snowflake
"""

FINTECH_NLP = """
NLP Engineer for an insurance FinTech

The job:
Letters about payments come in, answers go out.

Requirements:
- Minimum 4 years of NLP
- Must have: BERT and HuggingFace, in Python
- Search with Elasticsearch
- PostgreSQL required

Nice-to-have:
- Trading vocabulary
- SHAP

Bangalore or Remote
INR 20-38 LPA

Visa sponsorship is offered.
"""

MINIMAL = """
Our shop page needs care: JavaScript in front, Python behind.
Two releases a week; 3 years of experience required. Remote work.
"""

EDGE = {
    "empty": "",
    "short": "Cook wanted, Python a plus.",
    "caps": "SENIOR PYTHON COOK. 6+ YEARS EXPERIENCE. PYTORCH REQUIRED.",
    "unicode": "₹20–35 LPA. Python & PyTorch required. Bangalore — Hybrid.",
}

ALL = {
    "senior_ml": SENIOR_ML,
    "junior_data": JUNIOR_DATA,
    "director": DIRECTOR,
    "fintech_nlp": FINTECH_NLP,
    "minimal": MINIMAL,
    **EDGE,
}
