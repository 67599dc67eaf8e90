"""Column expressions: physics, solar geometry and calendars, all inside code generation."""
