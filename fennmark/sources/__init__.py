"""Tables from files and pages."""
