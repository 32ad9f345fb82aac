"""A small judged collection: chunks and thirteen queries with graded sources."""

#: Fixed values: (source, kind, path, text, time, role).
DOCUMENTS = [
    ("definition", "project", "src/memory/manager-search.ts", "export class HybridPersistenceCoordinator {\n  subscriptionActiveStateGate() { return restoreSubscriptions(); }\n}\n// Restores subscriptions after cloud sync.", None, None),
    ("test", "project", "tests/persistence.ts", "test('persistence coordinator restores subscriptions after cloud sync', () => {\n const coordinator = new HybridPersistenceCoordinator();\n});", None, None),
    ("caller", "project", "src/sync.ts", "function synchronizeCloud() {\n return new HybridPersistenceCoordinator().subscriptionActiveStateGate();\n}", None, None),
    ("path", "project", "src/empty-manager.ts", "export const unrelated = 42;", None, None),
    ("qualified", "project", "src/cache.cpp", "void Foo::Bar::bazValue() { refreshCache(); }", None, None),
    ("expansion", "project", "src/cleanup.rs", "fn delete_stale_entries() { database.remove_expired(); }", None, None),
    ("literal", "project", "src/fix.rs", "fn fixCache() { repair_cache(); }", None, None),
    ("alias", "project", "src/crash.rs", "fn crashRecovery() { restart(); }", None, None),
    ("diagnostic", "session", "history/old.jsonl", "Zone Not Found: stale CloudKit zone identity. Recreate the zone before replaying subscriptions.", "2024-01-01T00:00:00Z", "assistant"),
    ("reasoning", "session", "history/fix.jsonl", "Subscriptions disappear after cloud sync because a stale zone overwrites active state. Fixed by preserving the subscription active state gate during reconciliation.", "2026-09-01T00:00:00Z", "assistant"),
    ("decision", "session", "history/design.jsonl", "We chose SQLite transactions for checkpoint ownership because interrupted imports must never expose partial sessions. Architectural decision: atomic checkpoint commits.", "2025-12-01T00:00:00Z", "assistant"),
    ("old-symbol", "session", "history/symbol.jsonl", "HybridPersistenceCoordinator resolved the old checkpoint corruption.", "2023-01-01T00:00:00Z", "assistant"),
    ("new-noise", "session", "history/noise.jsonl", "Fresh status: checkpoint pending. Today we discussed routine formatting.", "2026-09-21T00:00:00Z", "user"),
    *((f"repeat-{i}", "project", f"generated/repeat-{i}.txt", "HybridPersistenceCoordinator persistence coordinator manager-search.ts " * 20, None, None) for i in range(18)),
    *((f"tool-{i}", "session", f"history/tool-{i}.jsonl", "subscriptions cloud sync active state checkpoint " * 200, "2026-09-21T00:00:00Z", "tool") for i in range(18)),
]

#: Fixed values: (query, kind, sources graded 3, sources graded 1).
CASES = [
    ("HybridPersistenceCoordinator", "project", ["definition"], ["test", "caller"]), ("persistence coordinator", "project", ["definition"], ["test", "caller"]), ("manager-search.ts", "project", ["definition"], []),
    ("src/empty-manager.ts", "project", ["path"], []), ("Foo::Bar::bazValue", "project", ["qualified"], []), ('"Zone Not Found"', "session", ["diagnostic"], []),
    ("why did subscriptions disappear after cloud sync?", "session", ["reasoning"], ["diagnostic"]), ("why did subscriptions disappear after cloud sync?", "project", ["definition"], ["test", "caller"]),
    ("architectural decision atomic checkpoint", "session", ["decision"], []), ("HybridPersistenceCoordinator", "session", ["old-symbol"], []), ("subscription active state", "project", ["definition"], ["test"]),
    ("panic", "project", ["alias"], []), ("fixCache", "project", ["literal"], []),
]

#: Published means of recall, reciprocal rank, nDCG and duplicate rate at ten, by the part that is switched off.
PUBLISHED = {
    None: (1.0, 0.9231, 0.9380, 0.0), "fields": (1.0, 0.9038, 0.9267, 0.0), "classification": (0.8462, 0.7308, 0.7598, 0.0), "exact": (1.0, 0.8462, 0.8852, 0.0), "expansion": (0.9231, 0.8462, 0.8611, 0.0),
    "dedupe": (1.0, 0.9231, 0.9154, 0.3538), "proximity": (1.0, 0.9231, 0.9380, 0.0), "decay": (1.0, 0.9231, 0.9380, 0.0), "weighted_similarity": (1.0, 0.9231, 0.9380, 0.0), "mmr": (1.0, 0.9231, 0.9380, 0.0),
}
