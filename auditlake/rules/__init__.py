"""The rule catalogue: patterns over sources, checks over elements, style rules, projects, routes and crawls."""
