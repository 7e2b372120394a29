"""Patterns and word lists that results depend on."""

from __future__ import annotations

# Prompt-injection patterns of the gate; the sixth needs a look-ahead.
INJECTION = (
    r"ignore\s+(all\s+)?previous\s+instructions?",
    r"ignore\s+(all\s+)?prior\s+instructions?",
    r"disregard\s+(all\s+)?previous",
    r"forget\s+(all\s+)?previous\s+instructions?",
    r"you\s+are\s+now\s+(a|an)\s+\w+",
    r"act\s+as\s+(if\s+you\s+are\s+)?(?!a\s+research)",
    r"pretend\s+(you\s+are|to\s+be)",
    r"system\s*:\s*",
    r"<\s*system\s*>",
    r"\[INST\]",
    r"###\s*instruction",
    r"new\s+instructions?\s*:",
    r"override\s+(safety|instructions?|guidelines?)",
)

# Patterns stripped from queries and snippets.
STRIP = (
    r"ignore\s+(all\s+)?previous\s+instructions?",
    r"ignore\s+(all\s+)?prior\s+instructions?",
    r"disregard\s+(all\s+)?previous",
    r"forget\s+(all\s+)?previous\s+instructions?",
    r"you\s+are\s+now\s+(a|an)\s+\w+",
    r"pretend\s+(you\s+are|to\s+be)",
    r"system\s*:\s*",
    r"<\s*system\s*>.*?<\s*/\s*system\s*>",
    r"\[INST\].*?\[/INST\]",
    r"###\s*instruction[s]?\s*:",
    r"new\s+instructions?\s*:",
    r"override\s+(safety|instructions?|guidelines?)",
    r"act\s+as\s+(?!a\s+research)",
)

# Topics that are in the domain whatever else a query says.
IN_DOMAIN = (
    r"\b(llm|language\s+model|transformer|attention)\b",
    r"\b(quantiz|quant|fp8|fp16|bf16|int8|int4|gguf|ggml)\w*",
    r"\b(flash\s*attention|paged\s*attention|ring\s*attention)\b",
    r"\b(lora|qlora|peft|adapter|fine.?tun)\w*",
    r"\b(vllm|trtllm|tensorrt|triton|cuda|cudnn)\b",
    r"\b(kv.?cache|key.?value\s+cache|speculative\s+decod)\w*",
    r"\b(inference|throughput|latency|token.?per.?second)\b",
    r"\b(benchmark|evaluat|mmlu|humaneval|hellaswag)\w*",
    r"\b(mixtral|llama|mistral|gemma|qwen|falcon|bloom)\b",
    r"\b(h100|a100|gpu\s+memory|vram|tensor\s+core)\b",
    r"\b(batch(ing)?|continuous\s+batch|paged\s+kv)\b",
    r"\b(safetensors|checkpoint|weight|gradient)\b",
    r"\b(rag|retrieval.?augmented|embedding|vector\s+(store|db|search))\b",
)

# Topics outside the domain.
OFF_DOMAIN = (
    r"\b(recipe|cooking|baking|ingredient)\b",
    r"\b(weather|forecast|temperature)\b(?!.*\b(model|training|inference)\b)",
    r"\b(stock\s+price|cryptocurrency|bitcoin|forex)\b",
    r"\b(celebrity|gossip|sports\s+score)\b",
    r"\b(dating|relationship\s+advice)\b",
    r"\b(homework|essay\s+writing|write\s+my\s+(essay|report|thesis))\b",
)

# Phrases of navigation and consent banners.
BOILERPLATE = (
    r"accept\s+(all\s+)?cookies?",
    r"cookie\s+policy",
    r"privacy\s+policy",
    r"terms\s+of\s+service",
    r"subscribe\s+to\s+(our\s+)?newsletter",
    r"sign\s+up\s+for\s+free",
    r"click\s+here\s+to",
    r"javascript\s+(is\s+)?required",
    r"enable\s+javascript",
    r"skip\s+to\s+(main\s+)?content",
    r"back\s+to\s+top",
)

# Words that carry no grounding signal.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "has", "have", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "can", "shall", "and", "or", "but", "nor", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "into",
    "through", "during", "this", "that", "these", "those", "it", "its", "they", "their", "our", "we", "you", "your", "he", "she", "his", "her",
    "also", "which", "who", "what", "when", "where", "how", "not", "no", "so", "if", "about", "than", "then", "up",
)

# Headings known by their words.
HEADINGS = (
    "abstract", "introduction", "conclusion", "references", "acknowledgments", "acknowledgements", "appendix",
)

# Tokens and markers.
MARKDOWN_NOISE = r"```.*?```|`([^`\n]+)`|\*{1,3}([^*\n]+)\*{1,3}|#{1,6}\s|\[([^\]]+)\]\([^)]+\)|!\[[^\]]*\]\([^)]+\)|\|[-:]+\||---+|===+"
TECH_TOKEN = r"[a-z0-9]+(?:[-_.][a-z0-9]+)+|[a-z]+[0-9]+|[0-9]+[a-z]+|[0-9]+\.[0-9]+"
WORD = r"[a-z0-9]{2,}"
COUNTED_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
NUMBER = r"\b([0-9]+(?:\.[0-9]+)?(?:[x%]|(?:\s?(?:billion|million|trillion|GB|MB|KB|ms|tokens?)))?)"
UNIT = r"\s?(?:x|%|billion|million|trillion|GB|MB|KB|ms|tokens?)$"
CITATION = r"\[([0-9]+)\]"
HTML_ENTITY = r"&[a-zA-Z]{2,8};|&#[0-9]{1,6};|&#x[0-9a-fA-F]{1,6};"
NUMBERED_HEADING = r"^\s*[0-9]+(?:\.[0-9]+)*\s+[A-Z].+$"

# Language of a source file by its extension.
LANGUAGES = {
    ".py": "python", ".ipynb": "json", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".cpp": "cpp",
    ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".cu": "cpp", ".md": "markdown", ".txt": "text", ".json": "json",
    ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".ini": "ini", ".sh": "bash", ".ps1": "powershell",
}

# Markdown headings, section numbers, anchors beside headings, and the openings of fences and table rows.
HEADING = r"^(#{1,4})\s+(.+)$"
SECTION_NUMBER = r"^([0-9][A-Z0-9]*(?:\.[A-Z0-9]+)*|[A-Z](?:\.[A-Z0-9]+)+)\s+\S"
ANCHOR = r'\s*\[(?:#|¶)\]\((?:[^()"]|"[^"]*")*\)(?:\s*"[^"]*")?'
FENCE = r"^\s*(```|~~~)"
TABLE_ROW = r"^\s*\|"

# Elements that are no content of a page, and classes that name a language by themselves.
NOISE_ELEMENTS = ("script", "style", "nav", "footer", "header", "aside", "form", "button", "svg")
CODE_CLASS = r"(?:language|lang)[-_]([a-z0-9_+-]+)"
CODE_LANGUAGES = ("python", "cpp", "c", "javascript", "typescript", "bash", "shell", "json", "yaml")
