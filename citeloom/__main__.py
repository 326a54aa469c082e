from citeloom.plans.cli import main

raise SystemExit(main())
