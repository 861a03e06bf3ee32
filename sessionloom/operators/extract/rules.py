"""Patterns and word lists of the extraction rules.

Fixed values: results depend on them, so they stand here together, in the order in which they apply.
"""

NOISE = [
    r"this session is being continued", r"conversation is summarized below", r"previous conversation that ran out of context",
    r"here is the summary", r"summary of the conversation", r"context from previous session", r"let me summarize",
    r"to summarize what we've done", r"^I'll help you", r"^Let me help you", r"^Sure,? I can", r"^I understand", r"^Great question",
]
SHORT_NOISE = NOISE[:3]
MISTAKE_NOISE = NOISE[:5]

DECISIONS = [
    r"(?:using|use|implement|adopt)\s+(.+?)\s+(?:instead of|over|rather than)\s+(.+?)\s+(?:because|since|as|for)\s+(.+?)(?:\.|\z)",
    r"(?:architectural|technical|design)\s+decision:\s*(.+?)(?:\.|\z)",
    r"(?:we|i)\s+(?:decided|chose)\s+(?:to\s+)?(.+?)\s+(?:because|since|due to|for)\s+(.+?)(?:\.|\z)",
    r"(?:rejected|dismissed|avoided|ruled out)\s+(.+?)\s+(?:because|due to|since|as)\s+(.+?)(?:\.|\z)",
]
DECISION_BLOCK = r"(?:Decision|Chose|Selected|Using):\s*([^\n]+)(?:\s*Rationale:\s*([^\n]+))?(?:\s*Alternatives:\s*([^\n]+))?"
CORRECTIONS = [
    r"^no[,\s]+(?:use|implement|go with)\s+(.+?)\s+(?:instead|rather)",
    r"^actually[,\s]+(?:we should|you should|use|implement)\s+(.+?)\s+(?:because|since)",
    r"that'?s?\s+(?:wrong|incorrect)[,\s]+(?:the correct|use|we should)\s+(.+)",
    r"don't\s+(?:use|implement)\s+(.+?)[,\s]+(?:use|implement)\s+(.+)",
]
CONTEXTS = ["authentication", "auth", "database", "api", "frontend", "backend", "testing", "deployment", "security", "performance", "architecture", "design pattern", "library", "framework", "optimization"]
TECHNICAL = ["function", "class", "method", "variable", "import", "export", "component", "module", "package", "library", "framework", "database", "query", "api", "endpoint", "route", "config", "setting", "type", "interface", "schema"]

MISTAKE_TYPES = {
    "logic_error": [r"logic\s+error", r"incorrect\s+logic", r"wrong\s+condition"],
    "wrong_approach": [r"wrong\s+approach", r"better\s+way", r"should\s+(?:have\s+)?use(?:d)?"],
    "misunderstanding": [r"misunderstood", r"(?:didn't|don't)\s+understand", r"confused\s+about"],
    "syntax_error": [r"syntax\s+error", r"parse\s+error", r"invalid\s+syntax"],
}
USER_CORRECTIONS = [
    r"that'?s?\s+(?:wrong|incorrect|a mistake)[,\s]+(?:you should|use|the correct)",
    r"(?:you|that)\s+(?:made|caused|introduced)\s+(?:a|an)\s+(?:error|bug)\s+(?:in|with|when)",
    r"don't\s+do\s+that[,\s]+(?:because|it will|it causes)",
    r"(?:should not|shouldn't)\s+(?:have\s+)?(?:done|used)\s+(.+?)\s+(?:because|since)",
    r"(?:fix|correct)\s+(?:the|that)\s+(?:bug|error)\s+(?:in|with)",
]
ERROR_TALK = [r"error:\s*\w+", r"failed:\s*.+", r"exception:\s*.+", r"TypeError:|ReferenceError:|SyntaxError:", r"ENOENT|EACCES|EPERM", r"command\s+failed", r"exit\s+code\s+[1-9]"]
DESCRIPTIVE = [
    r"permission denied", r"host key verification failed", r"connection refused", r"no such file or directory", r"command not found", r"authentication failed",
    r"timeout", r"could not resolve", r"network is unreachable", r"operation not permitted", r"access denied", r"invalid argument", r"no space left",
    r"disk quota exceeded", r"broken pipe", r"connection reset", r"refused|denied|failed|error:|fatal:",
]
FIXED = r"(?:fixed|resolved|corrected|solved)"

REQUIREMENTS = [
    ("dependency", r"(?:need|require|must use|depends on)\s+(.+?)\s+(?:library|package|module|dependency)"),
    ("dependency", r"(?:install|add)\s+(.+?)\s+(?:for|to)"),
    ("performance", r"(?:must|should|need to)\s+(?:be|run)\s+(?:faster|slower|within|under)\s+(.+)"),
    ("performance", r"response time\s+(?:must|should)\s+(?:be\s+)?(?:under|less than|within)\s+(.+)"),
    ("performance", r"(?:latency|throughput|performance)\s+requirement:\s*(.+)"),
    ("compatibility", r"(?:must|should|need to)\s+(?:support|work with|be compatible with)\s+(.+)"),
    ("compatibility", r"(?:requires?|needs?)\s+(.+?)\s+(?:version|or higher|or later)"),
    ("business", r"business requirement:\s*(.+)"),
    ("business", r"(?:must|cannot|can't)\s+(?:exceed|violate|break)\s+(.+)"),
    ("business", r"(?:constraint|limitation):\s*(.+)"),
]
TEST_COMMANDS = [r"(?:npm|yarn|pnpm)\s+test", r"(?:npm|yarn|pnpm)\s+run\s+test", r"pytest", r"jest", r"mocha", r"cargo\s+test", r"go\s+test"]

PROBLEM_START = [
    r"(?:I need to|help me|can you|let's|we need to|I want to)\s+(.+?)(?:\.|\z)", r"(?:how do I|how can I|what's the best way to)\s+(.+?)(?:\?|\z)",
    r"(?:fix|solve|resolve|implement|create|build|add|update|refactor|debug)\s+(.+?)(?:\.|\z)", r"(?:there's (?:a|an)|I have (?:a|an))\s+(?:bug|error|issue|problem)\s+(?:in|with)\s+(.+?)(?:\.|\z)",
]
SUCCESS = [r"(?:done|complete|finished|working|fixed|resolved|implemented)", r"(?:successfully|correctly) (?:implemented|fixed|added)", r"(?:all tests pass|tests are passing)", r"✓|✅"]
FAILURE = [r"(?:failed|error|broken|doesn't work)", r"(?:still|continues to) (?:fail|error)", r"cannot|could not|unable to", r"✗|❌"]
PARTIAL = [r"(?:partially|almost|mostly) (?:done|working)", r"(?:some|few) (?:issues|problems) remain", r"needs? more work"]
APPROACHES = {
    "exploration": [r"let me (?:look|check|explore|examine|see)", r"first,? (?:I'll|let me) (?:understand|read|examine)", r"exploring the codebase"],
    "research": [r"(?:searching|looking up|researching)", r"(?:documentation|docs) (?:says|shows|indicates)", r"according to", r"best practices? (?:suggest|recommend)"],
    "implementation": [r"(?:I'll|let me) (?:implement|create|write|add)", r"(?:implementing|creating|writing|adding)", r"here's the (?:code|implementation)"],
    "debugging": [r"(?:debugging|investigating|tracing)", r"the (?:error|bug|issue) (?:is|was|occurs)", r"root cause", r"stack trace"],
    "refactoring": [r"(?:refactoring|restructuring|reorganizing)", r"(?:cleaning up|simplifying|improving)", r"better (?:structure|organization|design)"],
    "testing": [r"(?:testing|running tests|verifying)", r"test (?:passes|fails|results)", r"npm (?:test|run test)"],
}

DISCOVERIES = [
    r"(?:I (?:found|discovered|noticed|see) that)\s+(.+?)(?:\.|\z)", r"(?:it (?:appears|seems|looks like))\s+(.+?)(?:\.|\z)", r"(?:the (?:code|file|function|class|module) (?:shows|indicates|reveals))\s+(.+?)(?:\.|\z)",
    r"(?:according to (?:the|this))\s+(.+?)(?:\.|\z)", r"(?:based on (?:my|the) (?:analysis|reading|exploration))[,\s]+(.+?)(?:\.|\z)", r"(?:this (?:means|indicates|suggests|shows))\s+(.+?)(?:\.|\z)",
    r"(?:the (?:issue|problem|error) is)\s+(.+?)(?:\.|\z)", r"(?:(?:here's|here is) what I (?:found|learned))[:\s]+(.+?)(?:\.|\z)",
]
FINDING_SOURCES = {
    "code": [r"(?:in|from) the (?:code|file|source|implementation)", r"(?:looking at|reading|examining) (?:the )?[\w./]+\.\w+", r"(?:the function|class|method|variable)"],
    "documentation": [r"(?:according to|from|in) (?:the )?(?:docs|documentation|readme|guide)", r"the documentation (?:says|shows|indicates)", r"as (?:documented|specified|described) in"],
    "web": [r"(?:according to|from|based on) (?:the )?(?:web|online|internet)", r"searching|searched|googled|looked up", r"https?://"],
    "experimentation": [r"testing|tried|tested|experimented", r"(?:running|ran) (?:the )?(?:code|test|command)", r"the (?:result|output) (?:shows|is)"],
    "user_input": [r"you (?:said|mentioned|asked|told me)", r"based on (?:your|the user's) (?:input|request|question)"],
}
TOPICS = [r"(?:looking (?:at|into)|investigating|researching|exploring)\s+(.+?)(?:\.|,|\z)", r"(?:understanding|learning about|figuring out)\s+(.+?)(?:\.|,|\z)", r"(?:how (?:to|does)|what is|why does)\s+(.+?)(?:\?|\z)"]
RELEVANCE = {"high": [r"this is (?:critical|crucial|essential|important|key)", r"(?:directly|exactly) (?:what|how|why)", r"the (?:root cause|main issue|solution|answer)"], "medium": [r"(?:related|relevant) to", r"this (?:helps|explains|clarifies)", r"(?:might|could|may) (?:be|help)"], "low": [r"for (?:reference|future|later)", r"not (?:directly|immediately) (?:relevant|needed)", r"tangentially|incidentally"]}
SURENESS = {"verified": [r"confirmed|verified|proven|definitely|certainly", r"this is correct|I'm certain|no doubt", r"tests? (?:pass|confirm)|output shows"], "likely": [r"likely|probably|most likely|appears to be", r"seems|looks like|I (?:think|believe)"], "uncertain": [r"might|could|may|possibly|perhaps", r"I'm not sure|unclear|uncertain", r"needs? to (?:verify|confirm|check)"]}

CATEGORIES = {
    "error-handling": [r"error|exception|try|catch|throw", r"handling errors?|error handling"], "performance": [r"performance|optimization|slow|fast|efficient", r"caching|memoization|lazy"],
    "authentication": [r"auth|authentication|authorization|login|session|token", r"jwt|oauth|credentials"], "database": [r"database|db|sql|query|migration", r"sqlite|postgres|mysql|mongodb"],
    "api-design": [r"api|endpoint|route|rest|graphql", r"request|response|http"], "testing": [r"test|testing|spec|jest|mocha", r"unit test|integration test|e2e"],
    "refactoring": [r"refactor|restructure|reorganize|clean", r"extract|inline|rename"], "configuration": [r"config|configuration|settings|environment", r"env|dotenv|.env"],
    "file-operations": [r"file|read|write|path|directory", r"fs|filesystem|io"], "async-patterns": [r"async|await|promise|callback", r"concurrent|parallel|sequential"],
}
SOLUTIONS = [r"(?:the (?:solution|fix|answer) is to)\s+(.+?)(?:\.|\z)", r"(?:(?:to )?(?:solve|fix|resolve) this)[,\s]+(.+?)(?:\.|\z)", r"(?:the (?:correct|right|proper) (?:way|approach) is to)\s+(.+?)(?:\.|\z)", r"(?:(?:you (?:can|should)|we (?:can|should)) (?:use|apply|implement))\s+(.+?)(?:\.|\z)", r"(?:here's how to (?:fix|solve|handle) it)[:\s]+(.+?)(?:\.|\z)", r"(?:the (?:trick|key) is to)\s+(.+?)(?:\.|\z)"]
APPLIES_WHEN = [r"(?:when (?:you|we) (?:need|want) to)\s+(.+?)(?:\.|,|\z)", r"(?:if (?:you|we) (?:have|encounter|see))\s+(.+?)(?:\.|,|\z)", r"(?:for (?:situations|cases) (?:where|when))\s+(.+?)(?:\.|,|\z)", r"(?:this is useful when)\s+(.+?)(?:\.|,|\z)"]
AVOID_WHEN = [r"(?:(?:don't|do not) use this (?:when|if))\s+(.+?)(?:\.|,|\z)", r"(?:avoid (?:this|using this) (?:when|if))\s+(.+?)(?:\.|,|\z)", r"(?:this (?:won't|doesn't) work (?:when|if))\s+(.+?)(?:\.|,|\z)", r"(?:not (?:suitable|appropriate) (?:for|when))\s+(.+?)(?:\.|,|\z)"]
TECHNOLOGIES = [r"(?:in|for)\s+(typescript|javascript|python|ruby|go|rust)\b", r"\b(react|vue|angular|svelte|next\.?js|node\.?js|express|fastify)\b", r"\b(jest|mocha|pytest|rspec|vitest)\b"]
EFFECTIVENESS = [("excellent", [r"works? (?:perfectly|great|excellently)", r"exactly what (?:we|I) needed", r"solves? the problem completely"]), ("poor", [r"still (?:has|have) (?:issues|problems)", r"doesn't (?:fully|completely) (?:work|solve)", r"needs? more work"]), ("moderate", [r"mostly works?|works? for (?:most|some)", r"partial(?:ly)? (?:fixes|solves)", r"could be better"])]

LIVE_DECISIONS = [r"(?:I'll|I will|Let's|We should|I've decided to|Going to) ([^.]+)", r"(?:decided|choosing|opting|selecting) (?:to )?([^.]+)", r"(?:using|implementing|adopting) ([^.]+?) (?:for|because|since)", r"(?:the (?:best|right|correct) (?:approach|solution|way) is) ([^.]+)"]
LIVE_ERRORS = [r"error[:\s]+(.+)", r"failed[:\s]+(.+)", r"exception[:\s]+(.+)", r"cannot (.+)", r"unable to (.+)"]
TECH_FAMILIES = [r"typescript|javascript|python|rust|go", r"react|vue|angular|svelte", r"sqlite|postgres|mongodb|redis", r"api|rest|graphql|grpc", r"pattern|architecture|design"]

ACTIONABLE = ["use", "implement", "choose", "adopt", "prefer", "select", "create", "build", "switch", "migrate", "upgrade", "configure", "enable", "disable", "add", "remove", "install", "setup", "design", "architect", "structure", "organize", "refactor", "optimize"]
SUMMARY_START = [r"^session summary", r"^conversation summary", r"^in this session", r"^today we", r"^we discussed", r"^the following", r"^here's what", r"^recap:", r"^summary:"]
SHORT_REPLIES = [r"^(yes|no|ok|okay|sure|thanks|thank you|got it)", r"^(hi|hello|hey|good morning|good evening)", r"^(bye|goodbye|see you|later)", r"^\d+\.?\s*\z", r"^[a-z]\)?\s*\z", r"^•\s*\z", r"^-\s*\z"]
