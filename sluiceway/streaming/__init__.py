"""The same work as Structured Streaming queries; every target is replay-safe."""
