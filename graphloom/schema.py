"""Tables of the graph: key columns and types. Each label and edge is one DataFrame."""

from __future__ import annotations

#: Key columns and DDL of the node tables.
NODES: dict[str, tuple[list[str], str]] = {
    "modules": (["repo", "path"], "repo string, path string, language string, dialect string, hash string, loc int, hasSideEffects boolean, isBarrel boolean, moduleSystem string, docstring string"),
    "symbols": (["repo", "filePath", "name"], "repo string, filePath string, name string, kind string, scopeKind string, isExported boolean, exportKind string, isAsync boolean, isGenerator boolean, lineStart int, lineEnd int, signature string, docstring string, hash string, hasIO boolean, hasMutation boolean, isPure boolean, effectKinds array<string>, configKeysRead array<string>, throwTypes array<string>, pageRank double, betweenness double, fanIn long, fanOut long, communityId int, communityRole string, depthFromEntry int, reachableFromEntry boolean, isPublicApi boolean, architecturalLayer string, boundedContextId string, changeFrequency double, authorCount long, lastModified timestamp, gitAge int"),
    "external_packages": (["name"], "name string"),
    "call_sites": ([], "repo string, filePath string, calleeExpression string, argumentCount int, isNewExpression boolean, line int, resolutionStatus string"),
    "scopes": (["repo", "filePath", "scopeId"], "repo string, filePath string, scopeId string, kind string, lineStart int, lineEnd int, isStrict boolean, parentId string"),
    "comments": ([], "repo string, filePath string, kind string, text string, lineStart int, lineEnd int, hasDocTags boolean"),
    "code_references": ([], "repo string, filePath string, name string, bindingKind string, isRead boolean, isWrite boolean, isCall boolean, line int, `column` int, confidence double"),
    "flags": (["repo", "name"], "repo string, name string, providerHint string"),
    "external_services": (["repo", "name"], "repo string, name string, protocol string, detectionMethod string"),
    "index_errors": (["repo", "filePath"], "repo string, filePath string, reason string"),
    "error_flows": (["repo", "errorType"], "repo string, errorType string"),
    "config_items": (["repo", "key"], "repo string, key string"),
    "communities": (["repo", "communityId"], "repo string, communityId int, size long, coreCount long, boundaryCount long, bridgeCount long, cohesion double, coveragePct double"),
    "bounded_contexts": (["repo", "contextId"], "repo string, contextId string, name string, description string"),
    "symbol_summaries": (["symbolFqn"], "symbolFqn string, purpose string, details string, sideEffects string, semanticTags array<string>, tier string, model string, generatedAt timestamp, contentHash string, embedding array<float>, validationStatus string, stale boolean"),
    "community_summaries": (["repo", "communityId"], "repo string, communityId int, name string, purpose string, keySymbols array<string>, tier string, model string, generatedAt timestamp, symbolCount long, coveragePct double, embedding array<float>, stale boolean"),
    "documents": (["path"], "path string, title string, type string, status string, author string, domain string, service string, updatedAt timestamp, lastEnrichedHash string, body string"),
    "concepts": (["id"], "id string, name string, description string, embedding array<float>, createdAt timestamp, updatedAt timestamp"),
    "doc_postings": (["term", "path"], "term string, path string, tf long"),
    "doc_lengths": (["path"], "path string, length long, hash string"),
    "templates": (["name"], "name string, body string"),
    "metrics_meta": (["repo"], "repo string, lastEdgeCount long, updatedAt timestamp"),
    "runs": (["runId"], "runId string, kind string, status string, startedAt timestamp, endedAt timestamp, stats string, error string"),
    "unresolved_refs": ([], "runId string, path string, channel string, name string"),
    "pass_runs": (["runId", "pass"], "runId string, repo string, pass string, status string, startedAt timestamp, durationMs long, stats string, error string"),
}

#: Key columns and DDL of the edge tables; a symbol is named by its id ``repo:filePath#name``.
EDGES: dict[str, tuple[list[str], str]] = {
    "imports": (["repo", "source", "target"], "repo string, source string, target string, kind string, specifiers array<string>, line int"),
    "exports": (["repo", "module", "exportName"], "repo string, module string, exportName string, exportKind string, symbol string"),
    "parent_scope": (["repo", "filePath", "scopeId"], "repo string, filePath string, scopeId string, parentId string"),
    "annotated_by": ([], "repo string, filePath string, symbol string, kind string, commentLine int"),
    "resolves_to": ([], "repo string, filePath string, line int, `column` int, symbol string"),
    "calls": (["src", "dst"], "src string, dst string, repo string, confidence string"),
    "throws": (["symbol", "errorType"], "symbol string, errorType string, propagated boolean, confidence string"),
    "catches": (["symbol", "errorType"], "symbol string, errorType string, catchBlock string"),
    "reads_config": (["symbol", "key"], "symbol string, key string, accessPattern string"),
    "reads_flag": (["symbol", "flag"], "symbol string, flag string, checkKind string"),
    "imports_service": (["repo", "module", "service"], "repo string, module string, service string"),
    "calls_service": (["symbol", "service"], "symbol string, service string, protocol string, confidence string"),
    "test_asserts": (["test", "symbol"], "test string, symbol string, testFile string, coverageKind string"),
    "governs": (["doc_path", "symbol"], "doc_path string, symbol string"),
    "documented_by": (["doc_path", "symbol"], "doc_path string, symbol string"),
    "doc_references": (["doc_path", "target"], "doc_path string, target string, confidence string, channel string"),
    "mentioned_in": (["concept", "doc"], "concept string, doc string, confidence double, extractedAt timestamp"),
}

TABLES = NODES | EDGES
