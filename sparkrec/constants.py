"""Fixed values. Outputs, prompts and cache keys depend on these exact strings."""

# --- fixed values: category codes and names, in display order ---------------
CATEGORIES = (
    ("cs.LG", "Machine Learning"),
    ("cs.CV", "Computer Vision and Pattern Recognition"),
    ("cs.CL", "Computation and Language / NLP"),
    ("cs.AI", "Artificial Intelligence"),
    ("cs.RO", "Robotics"),
    ("cs.IR", "Information Retrieval"),
    ("cs.NE", "Neural and Evolutionary Computing"),
    ("cs.DC", "Distributed, Parallel, and Cluster Computing"),
    ("cs.CR", "Cryptography and Security"),
    ("cs.HC", "Human-Computer Interaction"),
    ("cs.SE", "Software Engineering"),
    ("cs.DS", "Data Structures and Algorithms"),
    ("stat.ML", "Statistics — Machine Learning"),
    ("stat.AP", "Statistics — Applications"),
    ("math.OC", "Mathematics — Optimization and Control"),
    ("eess.SP", "Signal Processing"),
    ("eess.IV", "Image and Video Processing"),
    ("quant-ph", "Quantum Physics"),
    ("physics.data-an", "Physics — Data Analysis"),
)

# --- fixed values: prompt texts ----------------------------------------------
HYDE_SYSTEM = """You are a researcher writing arxiv paper abstracts.

Given a user's search query, write a single hypothetical arxiv abstract
that would perfectly answer what the user is looking for.

Rules:
- Write ONLY the abstract text, no title, no authors, no preamble
- Match the style and density of real arxiv abstracts
- Include specific technical terms, methods, and results the paper would contain
- Length: 80–150 words
- Do not start with "Abstract:" or any label
"""

# {categories} is the rendered category list.
STEP_BACK_SYSTEM = """You are a research librarian specializing in academic paper classification.

Given a user query, do TWO things:

1. ABSTRACT the query into a broader, more general research question.
   - Remove colloquialisms and implementation details
   - Use formal academic language
   - Capture the underlying research problem, not the surface request

2. MAP the abstracted question to 1–3 arxiv category codes.

Available categories:
{categories}

Respond ONLY in this exact JSON format, no preamble, no markdown:
{{
  "abstracted_query": "the broader, formal research question",
  "categories": ["cs.LG"],
  "confidence": "high",
  "reasoning": "one sentence explaining the category choice"
}}

Confidence rules:
- "high":   query clearly belongs to specific categories (≥80% certain)
- "medium": query spans multiple areas or is somewhat ambiguous
- "low":    query is very vague, cross-disciplinary, or unclear

Category rules:
- Return 1–3 categories max, ordered by relevance
- If the query is not arxiv-relevant: return "categories": []
- Prefer specific over broad: cs.CL > cs.AI for NLP tasks
- A paper can span categories — use $or logic, not $and
"""

# {n} is the number of variants asked for.
FUSION_SYSTEM = """You are a research assistant helping search arxiv papers.

Given a user query, generate {n} different search queries that approach
the same topic from different angles — different terminology, different
framings, different levels of specificity.

Respond ONLY with a JSON array of strings. No preamble, no explanation.
Example: ["query one", "query two", "query three"]

Rules:
- Each query must be meaningfully different from the others
- Cover: technical terms, application domains, method names, problem framing
- Keep each query concise (5–12 words)
- Do NOT repeat the original query verbatim — rewrite it as one of the variants
"""

ANSWER_SYSTEM = (
    "You are a research assistant helping a user understand academic papers. "
    "Answer the user's query using ONLY the provided research documents. "
    "Cite specific papers by title or content when relevant. "
    "If the documents do not contain enough information to fully answer, "
    "say so clearly, then give the best partial answer you can. "
    "Be thorough but concise."
)

STEP_BACK_USER = "User query: %s"
FUSION_USER = "Original query: %s"
DOCUMENT_BLOCK = "--- Document %d ---\n%s\n"
ANSWER_USER = (
    "User query: %s\n\n"
    "Research documents (chunk %d):\n"
    "%s\n\n"
    "Please provide a comprehensive answer grounded in these documents."
)
SCHEMA_HINT = "Respond with a JSON object containing these keys: "
CHUNK_ERROR = "[Error generating response for chunk %d]"
PARSE_FALLBACK = "parse error — falling back to no category filter"
CALL_FALLBACK = "LLM error — falling back: %s"

# --- fixed values: progress messages ------------------------------------------
MSG_VARIANTS_START = "Generating query variants (HyDE, step-back, RAG fusion)..."
MSG_VARIANTS_DONE = "Generated %d query variants"
MSG_RETRIEVAL_START = "Retrieving documents across %d queries..."
MSG_RETRIEVAL_DONE = "Retrieved %d unique documents"
MSG_CHUNKING_DONE = "Split %d docs into %d chunk(s) of at most %d"
MSG_CHUNK_START = "Generating response for chunk %d..."
MSG_CHUNK_END = "Chunk %d complete."
MSG_PROMPT_REQUIRED = "input_prompt is required"

# --- fixed values: formats ----------------------------------------------------
CODE_FENCES = ("```json", "```")
FRAME_PREFIX = "data: "
FRAME_END = "\n\n"
MISSING_PERCENT = "—"
