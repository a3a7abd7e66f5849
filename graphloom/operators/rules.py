"""Rule tables of the passes. All values here are fixed: results must follow them."""

from __future__ import annotations

#: Path pattern, layer, priority. The first of the highest priority decides.
LAYERS = [
    (r"(^|/)(__tests__|__mocks__|tests?|spec)(/|$)", "test", 100),
    (r"\.(test|spec|e2e)\.[jt]sx?$", "test", 100),
    (r"(^|/)config(/|$)", "config", 80),
    (r"\.config\.[jt]sx?$", "config", 80),
    (r"(^|/)settings(/|$)", "config", 80),
    (r"(^|/)(routes|controllers|api|handlers|endpoints|resolvers)(/|$)", "api", 60),
    (r"(^|/)services(/|$)", "service", 50),
    (r"-service\.[jt]sx?$", "service", 50),
    (r"(^|/)(use-?cases|interactors|workflows|commands)(/|$)", "service", 50),
    (r"(^|/)(repositories|repos|dao|data-?access)(/|$)", "repository", 45),
    (r"-(repository|repo|dao)\.[jt]sx?$", "repository", 45),
    (r"(^|/)(domain|entities|models|aggregates|value-?objects)(/|$)", "domain", 40),
    (r"(^|/)(infra|infrastructure|adapters|gateways|clients)(/|$)", "infrastructure", 35),
    (r"(^|/)(utils?|helpers?|lib|common|shared)(/|$)", "utility", 20),
]
#: Names of all layers.
LAYER_NAMES = ["api", "service", "domain", "repository", "infrastructure", "utility", "test", "config", "unknown"]

#: Paths of test code, and of its kinds.
TESTS = [r"\.(test|spec|e2e)\.[jt]sx?$", r"(^|/)(__tests__|tests?|spec)(/|$)"]
E2E = [r"\.e2e\.[jt]sx?$", r"(^|/)e2e(/|$)"]
INTEGRATION = [r"\.integration\.[jt]sx?$", r"(^|/)integration(/|$)"]

#: Pattern of a callee and its effect; the first match of a call decides.
EFFECTS = [
    (r"^fs\.(readFile|readdir|readlink|stat|lstat|access|open|read)\b", "file-read"),
    (r"^(readFile|readdir|stat|access)(Sync)?\b", "file-read"),
    (r"^fs\.(writeFile|appendFile|write|mkdir|unlink|rmdir|rename|copyFile|symlink|chmod|chown)\b", "file-write"),
    (r"^(writeFile|appendFile|mkdir|unlink|rmdir)(Sync)?\b", "file-write"),
    (r"^fetch\b", "network-call"),
    (r"^axios(\.(get|post|put|patch|delete|head|options|request))?\b", "network-call"),
    (r"^https?\.(get|request|createServer)\b", "network-call"),
    (r"^(got|superagent|request|needle)\b", "network-call"),
    (r"^net\.(connect|createConnection|createServer)\b", "network-call"),
    (r"^(exec|execSync|spawn|spawnSync|fork|execFile|execFileSync)\b", "process-spawn"),
    (r"^child_process\.", "process-spawn"),
    (r"^(setTimeout|setInterval|setImmediate)\b", "timer"),
    (r"^document\.", "dom-mutation"),
    (r"^(dynamoDb|ddb|docClient|documentClient)\.(get|query|scan|getItem|batchGet)\b", "db-read"),
    (r"^(dynamoDb|ddb|docClient|documentClient)\.(put|update|delete|putItem|updateItem|deleteItem|batchWrite)\b", "db-write"),
    (r"^(db|pool|client|connection)\.(query|execute)\b", "db-read"),
]
#: Effects that are input or output.
IO_EFFECTS = ["file-read", "file-write", "network-call", "db-read", "db-write", "process-spawn", "dom-mutation"]

#: Method of a feature flag check, provider, kind of check.
FLAGS = [
    ("variation", "launchdarkly", "variant"),
    ("boolVariation", "launchdarkly", "variant"),
    ("stringVariation", "launchdarkly", "variant"),
    ("numberVariation", "launchdarkly", "variant"),
    ("jsonVariation", "launchdarkly", "variant"),
    ("isEnabled", "unleash", "is-enabled"),
    ("getVariant", "unleash", "is-enabled"),
    ("isOn", "growthbook", "is-enabled"),
    ("isOff", "growthbook", "is-enabled"),
    ("getFeatureValue", "growthbook", "is-enabled"),
    ("evalFeature", "growthbook", "is-enabled"),
    ("isActive", "custom", "is-enabled"),
    ("isFlagEnabled", "custom", "is-enabled"),
    ("isFeatureEnabled", "custom", "is-enabled"),
    ("isFeatureOn", "custom", "is-enabled"),
]

#: Package, service, protocol.
SDK_SERVICES = [
    ("stripe", "stripe", "http"),
    ("@stripe/stripe-js", "stripe", "http"),
    ("@sendgrid/mail", "sendgrid", "http"),
    ("twilio", "twilio", "http"),
    ("nodemailer", "smtp", "http"),
    ("pg", "postgres", "http"),
    ("mysql2", "mysql", "http"),
    ("mysql", "mysql", "http"),
    ("mongoose", "mongodb", "http"),
    ("redis", "redis", "http"),
    ("ioredis", "redis", "http"),
    ("@elastic/elasticsearch", "elasticsearch", "http"),
    ("elasticsearch", "elasticsearch", "http"),
    ("kafkajs", "kafka", "amqp"),
    ("amqplib", "rabbitmq", "amqp"),
    ("@aws-sdk/client-dynamodb", "dynamodb", "http"),
    ("@aws-sdk/lib-dynamodb", "dynamodb", "http"),
    ("@aws-sdk/client-s3", "s3", "http"),
    ("@aws-sdk/client-sns", "sns", "http"),
    ("@aws-sdk/client-sqs", "sqs", "http"),
    ("@aws-sdk/client-lambda", "lambda", "http"),
    ("@aws-sdk/client-rds-data", "rds", "http"),
    ("@aws-sdk/client-bedrock-runtime", "bedrock", "http"),
    ("firebase-admin", "firebase", "http"),
    ("firebase", "firebase", "http"),
    ("@google-cloud/firestore", "firestore", "http"),
    ("@google-cloud/bigquery", "bigquery", "http"),
    ("@supabase/supabase-js", "supabase", "http"),
]

#: Words that are no identifiers when they stand in inline code.
NO_IDENTIFIERS = (
    "null undefined true false new return const let var class interface type enum function async await import "
    "export default from this super extends implements string number boolean object array promise error "
    "console process module require exports"
).split()

#: Marks of the section that reconciliation writes into a document.
RELATED_BEGIN = "<!-- enrichment:related-code:begin -->"
RELATED_END = "<!-- enrichment:related-code:end -->"
