"""Fixed values that results depend on: pattern and word lists, in their order."""

# Features of a text
CODE_BLOCK = r"```(\w*)\n([\s\S]*?)```"
URL = r"https?://(?:[\w-]+\.)+[\w-]+(?:/[^\s<>\"'`\[\]{}|\\^]*)?"
ERRORS = [r"(?i)Traceback \(most recent call last\)", r"(?m)^\s*File \"[^\"]+\", line \d+", r"(?i)(?:Error|Exception):\s+\S+", r"at\s+[\w.$]+\s*\([^)]+:\d+:\d+\)", r"(?i)panic:\s+", r"(?i)FATAL\s+ERROR:"]
FILES = [
    r"\b[\w./\\-]+\.(?:py|js|ts|jsx|tsx|java|cpp|c|h|go|rs|rb|php|swift|kt)\b",
    r"\b[\w./\\-]+\.(?:json|yaml|yml|toml|xml|ini|cfg|conf)\b",
    r"\b[\w./\\-]+\.(?:html|css|scss|sass|less)\b",
    r"\b[\w./\\-]+\.(?:csv|sql|md|txt|log)\b",
    r"\b[\w./\\-]+\.(?:sh|bash|zsh)\b",
]
QUESTIONS = {
    "how-to": r"(?i)\bhow\s+(?:do|can|to|should|would|could)\b",
    "why": r"(?i)\bwhy\s+(?:is|does|do|are|was|were|would|should)\b",
    "what": r"(?i)\bwhat\s+(?:is|are|does|do|was|were)\b",
    "debug": r"(?i)\b(?:error|bug|issue|problem|not\s+working|fails?|broken|wrong|fix)\b",
    "explain": r"(?i)\b(?:explain|understand|clarify|meaning|means|difference)\b",
    "compare": r"(?i)\b(?:vs\.?|versus|compare|comparison|better|worse|prefer)\b",
    "implement": r"(?i)\b(?:implement|create|build|make|write|code)\b",
}
TERMS = [
    "python", "javascript", "typescript", "java", "golang", "rust", "ruby", "php", "swift", "kotlin",
    "react", "vue", "angular", "django", "flask", "fastapi", "express", "nextjs", "rails", "spring",
    "sql", "postgresql", "postgres", "mysql", "mongodb", "redis", "elasticsearch", "sqlite",
    "docker", "kubernetes", "aws", "gcp", "azure", "terraform", "ansible", "jenkins", "github",
    "api", "rest", "graphql", "websocket", "async", "await", "promise", "callback",
    "authentication", "authorization", "oauth", "jwt", "cors", "csrf",
    "cache", "caching", "cdn", "load balancer", "microservices", "serverless",
    "git", "ci/cd", "pipeline", "deployment", "container", "virtualization",
    "testing", "unit test", "integration test", "tdd", "bdd", "mock", "fixture",
    "machine learning", "deep learning", "neural network", "nlp", "llm",
]
LANGUAGE_ALIASES = {"py": "python", "js": "javascript", "ts": "typescript", "sh": "bash", "shell": "bash", "yml": "yaml", "rb": "ruby", "rs": "rust"}

# scoring
WEIGHTS = {"technical_depth": 25, "practical_value": 30, "completeness": 20, "clarity": 15, "uniqueness": 10}
ADVANCED = [r"(?i)\basync\b.*\bawait\b", r"(?i)\bgenerics?\b|\btype\s+parameter", r"(?i)\brecursion\b|\brecursive\b", r"(?i)\bconcurrency\b|\bparallel\b|\bthread", r"(?i)\boptimiz\w+\b", r"(?i)\balgorithm\b|\bdata structure\b", r"(?i)\bdesign pattern\b|\barchitecture\b", r"(?i)\bscalability\b|\bperformance\b", r"(?i)\bsecurity\b|\bencryption\b|\bauth", r"(?i)\bmicroservice\b|\bdistributed\b"]
PRACTICAL = [r"```\w*\n[\s\S]+```", r"(?i)\bexample\b.*:|\bhere's how\b", r"(?i)\bstep\s+\d+\b|\bfirst,?\s+\w+\b.*\bthen\b", r"(?i)\binstall\b|\bsetup\b|\bconfigure\b", r"(?i)\bcommand\b|\bterminal\b|\bbash\b", r"`[^`]+`", r"(?i)\bfile\s*:\s*\S+", r"https?://\S+"]
CLARITY = [r"(?i)\bin\s+(?:other\s+)?words\b", r"(?i)\bfor\s+example\b|\be\.g\.\b|\bi\.e\.\b", r"(?i)\bthis\s+means\b|\bspecifically\b", r"(?i)\bstep\s+by\s+step\b", r"(?i)\bsummary\b|\bto\s+summarize\b", r"(?i)\bkey\s+(?:point|takeaway)\b", r"(?m)^\s*[-*•]\s+", r"(?m)^\s*\d+\.\s+"]
GRADES = [(95, "A+"), (90, "A"), (87, "A-"), (85, "B+"), (75, "B"), (70, "B-"), (65, "C+"), (50, "C"), (45, "C-"), (35, "D")]

# Personal data; type, pattern, severity (higher is worse), confidence
PII = [
    ("email", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b", 2, 0.95),
    ("phone", r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b", 2, 0.8),
    ("ssn", r"\b(?!000|666|9\d{2})\d{3}[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4}\b", 3, 0.85),
    ("credit_card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|(?:\d{4}[-\s]?){3}\d{4})\b", 3, 0.9),
    ("api_key", r"(?i)\b(?:sk-[a-zA-Z0-9]{32,}|sk-ant-[a-zA-Z0-9-]{32,}|api[_-]?key[\"'\s:=]+[\"']?[a-zA-Z0-9_-]{20,}[\"']?|bearer\s+[a-zA-Z0-9_-]{20,}|token[\"'\s:=]+[\"']?[a-zA-Z0-9_-]{20,}[\"']?)\b", 4, 0.9),
    ("aws_key", r"(?i)\b(?:AKIA[0-9A-Z]{16}|aws[_-]?(?:secret[_-]?)?(?:access[_-]?)?key[\"'\s:=]+[\"']?[A-Za-z0-9/+=]{40}[\"']?)\b", 4, 0.95),
    ("ip_address", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", 1, 0.9),
    ("mac_address", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", 1, 0.95),
    ("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}(?:[A-Z0-9]?){0,16}\b", 3, 0.85),
    ("date_of_birth", r"\b(?:(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-](?:19|20)\d{2}|(?:19|20)\d{2}[/-](?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[/-](?:0?[1-9]|1[0-2])[/-](?:19|20)\d{2})\b", 2, 0.7),
]
PII_DEFAULT = ["email", "phone", "ssn", "credit_card", "api_key", "aws_key", "ip_address"]
PRIVATE_IP = ["127.", "0.", "255.", "192.168.", "10."]

# Chains and segments
CONTINUATIONS = [r"(?i)(?:as|like)\s+(?:I|we)\s+(?:mentioned|discussed|said)\s+(?:earlier|before|previously)", r"(?i)continuing\s+(?:from|with|on)\s+(?:my|our|the)\s+(?:previous|earlier|last)", r"(?i)(?:back|returning)\s+to\s+(?:the|my|our)\s+(?:earlier|previous)", r"(?i)(?:following|building)\s+(?:up|on)\s+(?:from|what)", r"(?i)(?:still|again)\s+(?:having|getting|seeing)\s+(?:the|this|that)\s+(?:same|similar)", r"(?i)(?:remember|recall)\s+(?:when|that|the)\s+(?:we|I)"]
TOPIC_CHANGES = [r"(?i)(?:new|different|another|separate|unrelated)\s+(?:question|topic|issue|problem|thing)", r"(?i)(?:can|could)\s+(?:I|we)\s+(?:also|now)\s+(?:ask|discuss|talk about)", r"(?i)(?:moving|switching|changing)\s+(?:to|on to)\s+(?:a|another)", r"(?i)(?:by the way|btw|also|separately|on another note)", r"(?i)(?:one more thing|quick question|unrelated but)", r"(?i)(?:thanks|thank you)[.!]*\s*(?:now|also|can)"]
TECHS = {
    "python": r"(?i)\bpython\b|\.py\b|pip\s+install|import\s+\w+", "javascript": r"(?i)\bjavascript\b|\.js\b|npm\b|node\b|const\s+\w+\s*=", "typescript": r"(?i)\btypescript\b|\.ts\b|interface\s+\w+|type\s+\w+\s*=",
    "react": r"(?i)\breact\b|jsx\b|tsx\b|usestate|useeffect|component", "database": r"(?i)\bsql\b|database|query|select\s+\*|insert\s+into", "api": r"(?i)\bapi\b|\brest\b|endpoint|fetch\(|axios|request",
    "docker": r"(?i)\bdocker\b|container|dockerfile|docker-compose", "git": r"(?i)\bgit\b|commit|branch|merge|pull request", "testing": r"(?i)\btest\b|pytest|jest|unittest|mock|assert", "debugging": r"(?i)\bdebug\b|error|exception|traceback|stack trace",
}
CONCEPTS = {
    "architecture": r"(?i)\barchitecture\b|design pattern|structure|organize", "performance": r"(?i)\bperformance\b|optimiz|slow|fast|speed|memory", "security": r"(?i)\bsecurity\b|auth|password|encrypt|token|vulnerability",
    "deployment": r"(?i)\bdeploy\b|production|server|hosting|cloud", "data": r"(?i)\bdata\b|dataset|csv|json|parse|transform", "ui": r"(?i)\bui\b|ux|interface|frontend|css|style|layout",
}
SYNONYMS = {
    "money": ["finance", "budget", "cost", "price", "payment", "salary", "investment", "banking", "financial"],
    "family": ["parent", "child", "spouse", "relative", "brother", "sister", "mother", "father", "kids"],
    "work": ["job", "career", "employment", "office", "business", "professional", "colleague", "project"],
    "travel": ["trip", "vacation", "journey", "flight", "hotel", "tourism", "destination", "visit"],
    "food": ["eat", "restaurant", "cooking", "recipe", "meal", "dinner", "lunch", "breakfast"],
    "technology": ["computer", "software", "programming", "coding", "tech", "digital", "app", "website"],
    "health": ["medical", "doctor", "hospital", "medicine", "wellness", "fitness", "exercise", "therapy"],
    "education": ["school", "learning", "study", "course", "university", "teaching", "academic", "student"],
    "creative": ["art", "design", "music", "writing", "painting", "photography", "creative", "artistic"],
    "personal": ["private", "individual", "myself", "personal", "self", "own", "me", "my"],
}

# Entities of the graph
TECHNOLOGIES = {
    "python": r"(?i)\bpython\b", "javascript": r"(?i)\bjavascript\b|\bjs\b", "typescript": r"(?i)\btypescript\b|\bts\b", "rust": r"(?i)\brust\b",
    "go": r"(?i)\bgolang\b|\bgo\b(?!\s+(?:to|for|ahead|back))", "java": r"(?i)\bjava\b(?!script)", "c++": r"(?i)\bc\+\+\b|\bcpp\b", "ruby": r"(?i)\bruby\b",
    "php": r"(?i)\bphp\b", "swift": r"(?i)\bswift\b", "kotlin": r"(?i)\bkotlin\b",
    "react": r"(?i)\breact\b", "vue": r"(?i)\bvue(?:\.?js)?\b", "angular": r"(?i)\bangular\b", "django": r"(?i)\bdjango\b", "flask": r"(?i)\bflask\b",
    "fastapi": r"(?i)\bfastapi\b", "express": r"(?i)\bexpress\b", "nextjs": r"(?i)\bnext\.?js\b", "rails": r"(?i)\brails\b|\bruby on rails\b",
    "docker": r"(?i)\bdocker\b", "kubernetes": r"(?i)\bkubernetes\b|\bk8s\b", "git": r"(?i)\bgit\b(?!hub)", "github": r"(?i)\bgithub\b",
    "npm": r"(?i)\bnpm\b", "pip": r"(?i)\bpip\b", "webpack": r"(?i)\bwebpack\b", "vite": r"(?i)\bvite\b",
    "postgresql": r"(?i)\bpostgres(?:ql)?\b", "mysql": r"(?i)\bmysql\b", "mongodb": r"(?i)\bmongodb\b|\bmongo\b", "redis": r"(?i)\bredis\b", "sqlite": r"(?i)\bsqlite\b",
    "aws": r"(?i)\baws\b|\bamazon web services\b", "gcp": r"(?i)\bgcp\b|\bgoogle cloud\b", "azure": r"(?i)\bazure\b",
}
CONCEPT_WORDS = {
    "api": r"(?i)\bapi\b|\brest\b|\bgraphql\b", "authentication": r"(?i)\bauth(?:entication)?\b|\boauth\b|\bjwt\b",
    "testing": r"(?i)\btest(?:ing|s)?\b|\bunit test\b|\bpytest\b|\bjest\b", "deployment": r"(?i)\bdeploy(?:ment)?\b|\bci/?cd\b",
    "debugging": r"(?i)\bdebug(?:ging)?\b|\btroubleshoot", "performance": r"(?i)\bperformance\b|\boptimiz(?:e|ation)\b",
    "security": r"(?i)\bsecurity\b|\bvulnerabilit(?:y|ies)\b", "database": r"(?i)\bdatabase\b|\bsql\b|\bquery\b",
    "frontend": r"(?i)\bfrontend\b|\bclient.?side\b|\bui\b", "backend": r"(?i)\bbackend\b|\bserver.?side\b",
    "async": r"(?i)\basync\b|\bpromise\b|\bconcurrency\b", "caching": r"(?i)\bcach(?:e|ing)\b", "logging": r"(?i)\blog(?:ging|s)?\b",
    "error_handling": r"(?i)\berror handling\b|\bexception\b",
}
ERROR_NAME = r"(?i)(\w+(?:Error|Exception|Failure))(?:\s*:|:\s*|\s+)"
FILE_NAME = r"[\w./\\-]+\.(?:py|js|ts|jsx|tsx|java|go|rs|rb|php|vue|json|yaml|yml|toml|sql|md|html|css|scss)"

# Signs of a project
PATH = r"(?m)(?:^|[\s'\"(])(/(?:home|Users|var|opt|srv|projects?|repos?|work|code)/[a-zA-Z0-9_.-]+/[a-zA-Z0-9_./+-]+)"
REPOSITORY = r"(?i)(?:repository|repo|project|codebase)\s+(?:called\s+)?[\"']?([a-zA-Z][a-zA-Z0-9_-]+)[\"']?"
HOSTED = r"(?i)(?:github\.com|gitlab\.com|bitbucket\.org)/([a-zA-Z0-9_-]+/[a-zA-Z0-9_-]+)"
STACKS = {
    "react_frontend": ["react", "jsx", "tsx", "webpack", "vite", "next.js", "nextjs"],
    "vue_frontend": ["vue", "vuex", "nuxt", "pinia"],
    "angular_frontend": ["angular", "rxjs", "ngrx"],
    "python_backend": ["flask", "django", "fastapi", "sqlalchemy", "celery"],
    "node_backend": ["express", "nestjs", "koa", "prisma"],
    "rust_systems": ["rust", "cargo", "tokio", "actix"],
    "go_systems": ["golang", "gin", "goroutine"],
    "data_science": ["pandas", "numpy", "scikit-learn", "tensorflow", "pytorch"],
    "devops": ["docker", "kubernetes", "k8s", "terraform", "ansible"],
    "mobile": ["react native", "flutter", "swift", "kotlin"],
}
